"""Passes, threads and blocks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import blocks as B
from leafmark.operators import passes as P
from leafmark.operators import threads as H
from leafmark.plans.inputs import COMMENTS, LINES, OBSERVATIONS, comments, lines, observations, table

_PASSES = f"""{OBSERVATIONS},
named AS (SELECT * REPLACE (CASE WHEN author = '' THEN 'Unknown' ELSE author END AS author) FROM observations),
dated AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, author ORDER BY date_trunc('milliseconds', date), doc_order ROWS UNBOUNDED PRECEDING)::BIGINT AS pass_no FROM (
  SELECT *, CASE WHEN date_diff('millisecond', lag(date) OVER (PARTITION BY doc_id, author ORDER BY date_trunc('milliseconds', date), doc_order), date) > 48 * 3600 * 1000 THEN 1 ELSE 0 END AS fresh FROM named WHERE date IS NOT NULL)),
lasts AS (SELECT doc_id, author, max(pass_no) AS final FROM dated GROUP BY ALL),
assigned AS (
  SELECT doc_id, author, doc_order, kind, date, pass_no FROM dated UNION ALL
  SELECT n.doc_id, n.author, doc_order, kind, date, CASE WHEN coalesce(final, 0) = 0 THEN 0 ELSE final + 1 END FROM named n LEFT JOIN lasts l ON l.doc_id = n.doc_id AND l.author = n.author WHERE date IS NULL)"""

_COUNTS = "count(*) FILTER (kind = 'insertion') AS insertions, count(*) FILTER (kind = 'deletion') AS deletions, count(*) FILTER (kind = 'comment') AS comments, count(*) FILTER (kind = 'comment-reply') AS replies"


def pass_assignment(spark, sf_dir):
    return P.assign_passes(observations(spark, sf_dir)).select("doc_id", "author", "doc_order", "pass_no")


def passes(spark, sf_dir):
    return P.passes(observations(spark, sf_dir)).select("doc_id", "author", "pass_no", "window_start", "window_end", "insertions", "deletions", "comments", "replies", "undated", "label")


PASSES = f"""
WITH {_PASSES},
g AS (SELECT doc_id, author, pass_no, min(date) AS window_start, max(date) AS window_end, {_COUNTS} FROM assigned GROUP BY ALL),
s AS (SELECT doc_id, count(DISTINCT author) = 1 AND count(date) = 0 AS stripped FROM named GROUP BY 1)
SELECT g.doc_id, author, pass_no, window_start, window_end, insertions, deletions, comments, replies, window_start IS NULL AS undated,
  CASE WHEN stripped THEN author || ' (metadata stripped)' ELSE author || ' — ' || coalesce(strftime(window_start, '%Y-%m-%d'), 'undated') || ' (' ||
    (insertions + deletions) || ' edit' || CASE WHEN insertions + deletions = 1 THEN '' ELSE 's' END || ', ' || comments || ' comment' || CASE WHEN comments = 1 THEN '' ELSE 's' END || ', ' ||
    replies || ' repl' || CASE WHEN replies = 1 THEN 'y' ELSE 'ies' END || ')' END AS label
FROM g JOIN s ON s.doc_id = g.doc_id"""


def pass_members(spark, sf_dir):
    return P.members(observations(spark, sf_dir)).select("doc_id", "author", "pass_no", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def metadata_stripped(spark, sf_dir):
    """The documents, and every tenth observation three times more: without author and date, with a date, by two authors."""
    rows = observations(spark, sf_dir)
    tenth = rows.filter("doc_order % 10 = 0").withColumn("case", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    author = F.when((F.col("case") == 3) & (F.col("doc_order") % 20 == 0), F.lit("second")).otherwise("")
    made = tenth.select((-F.col("case")).cast("long").alias("doc_id"), "doc_order", "kind", author.alias("author"), F.when(F.col("case") == 2, F.lit("2026-01-01").cast("timestamp")).alias("date"))
    return P.stripped_metadata(rows.unionByName(made))


STRIPPED = f"""
WITH {OBSERVATIONS}, rows AS (
  SELECT doc_id, author, date FROM observations
  UNION ALL SELECT -c, CASE WHEN c = 3 AND doc_order % 20 = 0 THEN 'second' ELSE '' END, CASE WHEN c = 2 THEN TIMESTAMP '2026-01-01' END FROM observations, (VALUES (1), (2), (3)) AS v(c) WHERE doc_order % 10 = 0)
SELECT doc_id, count(DISTINCT CASE WHEN author = '' THEN 'Unknown' ELSE author END) = 1 AND count(date) = 0 AS metadata_stripped FROM rows GROUP BY 1"""


def alias_merge(spark, sf_dir):
    rows = observations(spark, sf_dir)
    k = F.col("id") * 10
    pairs = spark.range(15).select(F.concat(F.lit("reviewer "), (k + 1).cast("string")).alias("alias"), F.concat(F.lit("reviewer "), F.when(F.col("id") % 3 == 0, k + 11).otherwise(k + 2).cast("string")).alias("canonical"))
    return P.author_tally(P.merge_aliases(rows, P.resolve_aliases(pairs)))


ALIAS_MERGE = f"""
WITH RECURSIVE {OBSERVATIONS},
pairs AS (SELECT 'reviewer ' || (10 * i + 1) AS alias, 'reviewer ' || CASE WHEN i % 3 = 0 THEN 10 * i + 11 ELSE 10 * i + 2 END AS canonical FROM range(15) t(i)),
follow AS (SELECT alias, canonical, 0 AS depth FROM pairs UNION ALL SELECT f.alias, a.canonical, depth + 1 FROM follow f JOIN pairs a ON a.alias = f.canonical WHERE depth < 32),
ends AS (SELECT alias, arg_max(canonical, depth) AS canonical FROM follow GROUP BY alias)
SELECT coalesce(nullif(coalesce(canonical, author), ''), 'Unknown') AS author, count(*) AS n FROM observations LEFT JOIN ends ON alias = author GROUP BY 1"""


def author_tally(spark, sf_dir):
    return P.author_tally(observations(spark, sf_dir))


def author_kind_pivot(spark, sf_dir):
    return P.author_kind_pivot(observations(spark, sf_dir))


PIVOT = f"""WITH {OBSERVATIONS} SELECT CASE WHEN author = '' THEN 'Unknown' ELSE author END AS author, count(*) FILTER (kind = 'insertion') AS insertion, count(*) FILTER (kind = 'deletion') AS deletion,
  count(*) FILTER (kind = 'comment') AS comment, count(*) FILTER (kind = 'comment-reply') AS "comment-reply" FROM observations GROUP BY 1"""


def target_baseline(spark, sf_dir):
    return P.baseline(observations(spark, sf_dir), "Reviewer 5").select("doc_id", "doc_order", "author", "first_date")


BASELINE = f"""WITH {OBSERVATIONS}, f AS (SELECT doc_id, min(date) AS first_date FROM observations WHERE author = 'reviewer 5' GROUP BY 1)
SELECT o.doc_id, doc_order, CASE WHEN author = '' THEN 'Unknown' ELSE author END AS author, first_date FROM observations o JOIN f ON f.doc_id = o.doc_id WHERE author != 'reviewer 5' AND kind IN ('insertion', 'deletion') AND date < first_date"""


def corpus_records(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("doc_order"), F.when(F.col("turn") % 2 == 0, "insertion").otherwise("comment").alias("kind"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"))
    record = F.from_json("line", "doc_id long, target_author string, record_type string, kind string, context string, anchor string")
    return P.corpus_records(rows, "Assistant").select("doc_order", record.alias("r")).select("doc_order", "r.*")


CORPUS = """
SELECT turn AS doc_order, conv_id AS doc_id, role AS target_author, CASE WHEN turn % 2 = 0 THEN 'revision' ELSE 'comment' END AS record_type, CASE WHEN turn % 2 = 0 THEN 'insertion' ELSE 'comment' END AS kind,
  substr(coalesce(text, ''), 1, 500) AS context, printf('AR_REV_%05d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS anchor
FROM conversations WHERE role = 'assistant'"""


def next_unreviewed(spark, sf_dir):
    return P.next_unreviewed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("edit_id"), (F.col("l_returnflag") != "N").alias("reviewed")))


def attempts_by_gate(spark, sf_dir):
    gate = F.when(F.col("event_type") == "error", "G1").when(F.col("event_type") == "click", "G2")
    return P.attempts_by_gate(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("attempt_no"), gate.alias("gate")))


ATTEMPTS = """
WITH a AS (SELECT user_id AS doc_id, event_id AS attempt_no, CASE event_type WHEN 'error' THEN 'G1' WHEN 'click' THEN 'G2' END AS gate FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY attempt_no) - row_number() OVER (PARTITION BY doc_id, gate ORDER BY attempt_no) AS island FROM a)
SELECT doc_id, attempt_no, gate, row_number() OVER (PARTITION BY doc_id, gate, island ORDER BY attempt_no) AS consecutive, count(*) OVER (PARTITION BY doc_id, gate) AS of_gate FROM c"""

_THREAD = f"""RECURSIVE {COMMENTS},
thread AS (SELECT doc_id, comment_id, comment_id AS root_id, 0 AS depth, [comment_id] AS path FROM comments WHERE parent_id IS NULL
  UNION ALL SELECT c.doc_id, c.comment_id, root_id, depth + 1, list_append(path, c.comment_id) FROM thread t JOIN comments c ON c.doc_id = t.doc_id AND c.parent_id = t.comment_id)"""


def thread_expand(spark, sf_dir):
    return H.expand(comments(spark, sf_dir)).select("doc_id", "comment_id", "root_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def thread_render(spark, sf_dir):
    return H.render(comments(spark, sf_dir))


RENDER = f"""WITH {_THREAD}
SELECT t.doc_id, root_id, string_agg('{{>>' || CASE WHEN depth > 0 THEN repeat('↳', depth) || ' ' ELSE '' END || author || CASE WHEN date IS NOT NULL THEN ' (' || substr(date, 1, 10) || ')' ELSE '' END || CASE WHEN done THEN ' [resolved]' ELSE '' END || ': ' || text || '<<}}', '' ORDER BY path) AS thread
FROM thread t JOIN comments c ON c.doc_id = t.doc_id AND c.comment_id = t.comment_id GROUP BY ALL"""


def comment_totals(spark, sf_dir):
    return H.totals(comments(spark, sf_dir))


def comments_extended(spark, sf_dir):
    rows = comments(spark, sf_dir)
    para = F.format_string("%08X", F.col("comment_id") + 1)
    paragraphs = rows.select("doc_id", para.alias("para_id"), "comment_id").unionByName(rows.select("doc_id", F.format_string("%08X", F.col("comment_id") + 1001).alias("para_id"), "comment_id"))
    known = rows.filter("doc_id % 3 != 0 and comment_id % 5 != 4")
    extended = known.select("doc_id", para.alias("para_id"), F.format_string("%08X", F.col("parent_id") + 1001).alias("parent_para_id"), F.coalesce("done", F.lit(False)).alias("done"))
    extended = extended.withColumn("parent_para_id", F.when(F.col("parent_para_id") != "null", F.col("parent_para_id")))
    return H.resolve_extended(rows, paragraphs, extended).select("doc_id", "comment_id", "done", "parent_id")


EXTENDED = f"""
WITH {COMMENTS}, h AS (SELECT DISTINCT doc_id FROM comments WHERE doc_id % 3 != 0 AND comment_id % 5 != 4)
SELECT c.doc_id, comment_id, CASE WHEN h.doc_id IS NOT NULL THEN comment_id % 5 != 4 AND coalesce(done, false) END AS done, CASE WHEN h.doc_id IS NOT NULL AND comment_id % 5 != 4 THEN parent_id END AS parent_id
FROM comments c LEFT JOIN h ON h.doc_id = c.doc_id"""

_OFFSETS = f"""{LINES}, blocks AS (SELECT *, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS md_start, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT + length(line) AS md_end
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_CHUNKS = f"""{_OFFSETS}, indexed AS (SELECT *, greatest(sum(CASE WHEN line_no % 7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY md_start ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS chunk_index FROM blocks),
chunked AS (SELECT *, CASE WHEN chunk_index = 0 THEN 0 ELSE min(md_start) OVER (PARTITION BY doc_id, chunk_index) END AS base_offset FROM indexed)"""


def block_offsets(spark, sf_dir):
    return B.offsets(lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "md_start", "md_end")


def positional_anchors(spark, sf_dir):
    return B.positional_anchors(lines(spark, sf_dir)).select("doc_id", "anchor", "line")


_ANCHORED = f"{LINES}, anchored AS (SELECT doc_id, line_no, line, printf('AR_PARA_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY line_no)) AS anchor FROM lines)"


def bookmark_index(spark, sf_dir):
    return B.bookmark_index(B.positional_anchors(lines(spark, sf_dir)))


INDEX = f"""
WITH {_ANCHORED}, c AS (SELECT doc_id, line_no, anchor, trim(regexp_replace(translate(translate(line, '—–―−‑“”‘’ ', '-----""'''' '), chr(13) || chr(10), '  '), ' {{2,}}', ' ', 'g')) AS s FROM anchored WHERE trim(line) != '')
SELECT doc_id, '<<BOOKMARK_INDEX_START>>' || chr(13) || chr(10) || string_agg(anchor || ' | type=paragraph | "' || CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END || '"', chr(13) || chr(10) ORDER BY line_no) ||
  chr(13) || chr(10) || '<<BOOKMARK_INDEX_END>>' || chr(13) || chr(10) || chr(13) || chr(10) AS section FROM c GROUP BY doc_id"""


def chunk_split(spark, sf_dir):
    chunked = B.chunks(B.offsets(lines(spark, sf_dir)), F.col("line_no") % 7 == 3)
    return chunked.groupBy("doc_id", "chunk_index").agg(F.first("base_offset").alias("base_offset"), F.count(F.lit(1)).alias("blocks"), F.max("md_end").alias("chunk_end"))


def chunk_rebase(spark, sf_dir):
    chunked = B.chunks(B.offsets(lines(spark, sf_dir)), F.col("line_no") % 7 == 3)
    back = B.translate_edits(B.rebased(chunked).select("doc_id", "chunk_index", F.col("line_no").cast("long").alias("line_no"), F.col("md_start").alias("local_start"), "md_start", "md_end"), chunked.select("doc_id", "chunk_index", "base_offset").distinct())
    return back


def blank_collapse(spark, sf_dir):
    doubled = lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 5 < 3, F.col("line")).otherwise(F.lit(" ")))
    return B.collapse_blank_lines(doubled).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


BLANKS = f"""WITH {LINES}, d AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 < 3 THEN line ELSE ' ' END AS line FROM lines)
SELECT doc_id, line_no, line FROM d QUALIFY NOT (trim(line) = '' AND coalesce(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no)) = '', false))"""


def block_gaps(spark, sf_dir):
    return B.gaps(B.offsets(lines(spark, sf_dir)).filter("line_no % 2 = 0"))


def table_markdown(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return B.table_markdown(nation.select(F.col("n_regionkey").alias("table_id"), F.floor(F.col("n_nationkey") / 10).alias("row_no"), F.col("n_nationkey") % 4, F.when(F.col("n_nationkey") % 6 != 5, F.concat("n_name", F.lit(" | x"))).alias("text")).toDF("table_id", "row_no", "cell_no", "text"))


TABLES = """
WITH c AS (SELECT n_regionkey AS t, n_nationkey // 10 AS r, n_nationkey % 4 AS k, CASE WHEN n_nationkey % 6 != 5 THEN replace(trim(n_name || ' | x'), '|', '\\|') ELSE ' ' END AS s FROM nation),
w AS (SELECT t, max(k) + 1 AS width FROM c GROUP BY t), rr AS (SELECT DISTINCT t, r FROM c),
g AS (SELECT rr.t, rr.r, u.k, width FROM rr JOIN w ON w.t = rr.t, unnest(range(0, width)) AS u(k)),
l AS (SELECT g.t, g.r, g.width, '| ' || string_agg(coalesce(s, ' '), ' | ' ORDER BY g.k) || ' |' AS line FROM g LEFT JOIN c ON c.t = g.t AND c.r = g.r AND c.k = g.k GROUP BY ALL),
a AS (SELECT t, r::DOUBLE AS o, line FROM l UNION ALL SELECT t, min(r) + 0.5, '| ' || array_to_string(list_transform(range(0, any_value(width)), lambda x: '---'), ' | ') || ' |' FROM l GROUP BY t)
SELECT t AS table_id, string_agg(line, chr(10) ORDER BY o) AS markdown FROM a GROUP BY t"""

QUERIES = {
    "pass_assignment": (pass_assignment, f"WITH {_PASSES} SELECT doc_id, author, doc_order, pass_no FROM assigned"),
    "passes": (passes, PASSES),
    "pass_members": (pass_members, f"WITH {_PASSES} SELECT doc_id, author, pass_no, string_agg(doc_order::VARCHAR, ',' ORDER BY doc_order) AS members FROM assigned GROUP BY ALL"),
    "metadata_stripped": (metadata_stripped, STRIPPED),
    "alias_merge": (alias_merge, ALIAS_MERGE),
    "author_tally": (author_tally, f"WITH {OBSERVATIONS} SELECT CASE WHEN author = '' THEN 'Unknown' ELSE author END AS author, count(*) AS n FROM observations GROUP BY 1"),
    "author_kind_pivot": (author_kind_pivot, PIVOT),
    "target_baseline": (target_baseline, BASELINE),
    "corpus_records": (corpus_records, CORPUS),
    "next_unreviewed": (next_unreviewed, "SELECT l_orderkey AS doc_id, min(l_linenumber) FILTER (l_returnflag = 'N') AS next_edit, bool_and(l_returnflag != 'N') AS all_reviewed FROM lineitem GROUP BY 1"),
    "attempts_by_gate": (attempts_by_gate, ATTEMPTS),
    "thread_expand": (thread_expand, f"WITH {_THREAD} SELECT doc_id, comment_id, root_id, depth::BIGINT AS depth, array_to_string(path, '/') AS path FROM thread"),
    "thread_render": (thread_render, RENDER),
    "comment_totals": (comment_totals, f"WITH {COMMENTS} SELECT doc_id, count(*) AS total, count(*) FILTER (NOT coalesce(done, false)) AS unresolved, count(*) FILTER (parent_id IS NULL) AS threads FROM comments GROUP BY 1"),
    "comments_extended": (comments_extended, EXTENDED),
    "block_offsets": (block_offsets, f"WITH {_OFFSETS} SELECT doc_id, line_no, md_start, md_end FROM blocks"),
    "positional_anchors": (positional_anchors, f"WITH {_ANCHORED} SELECT doc_id, anchor, line FROM anchored WHERE trim(line) != ''"),
    "bookmark_index": (bookmark_index, INDEX),
    "chunk_split": (chunk_split, f"WITH {_CHUNKS} SELECT doc_id, chunk_index, min(base_offset) AS base_offset, count(*) AS blocks, max(md_end) AS chunk_end FROM chunked GROUP BY ALL"),
    "chunk_rebase": (chunk_rebase, f"WITH {_CHUNKS} SELECT doc_id, chunk_index, line_no, md_start - base_offset AS local_start, md_start, md_end FROM chunked"),
    "blank_collapse": (blank_collapse, BLANKS),
    "block_gaps": (block_gaps, f"WITH {_OFFSETS} SELECT doc_id, md_end AS gap_start, lead(md_start) OVER (PARTITION BY doc_id ORDER BY md_start) AS gap_end FROM blocks WHERE line_no % 2 = 0 QUALIFY gap_end IS NOT NULL"),
    "table_markdown": (table_markdown, TABLES),
}
