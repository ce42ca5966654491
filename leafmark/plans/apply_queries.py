"""Edit lines applied in order: orders as paragraphs, their line items as edits, and what becomes of every table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmark.operators import apply as P
from leafmark.plans.inputs import table

#: By key: change type, old text, new text or comment; a line that isn't to be applied; a target that isn't there.
_SHAPES = [
    '"change_type":"replace_text","old_text":"status","new_text":"state"',
    '"change_type":"replace_text","old_text":"state","new_text":"condition of","add_comment":"wording","confidence":"h"',
    '"change_type":"replace_text","old_text":"- \\"","new_text":"- the \\""',
    '"change_type":"replace_text","old_text":"absent","new_text":"x"',
    '"change_type":"add_footnote","new_text":"note AR_PARA_00001 here"',
    '"change_type":"add_footnote","old_text":"customer","new_text":"at customer"',
    '"change_type":"delete_element","add_comment":"gone"',
    '"change_type":"replace_text","new_text":"Rewritten AR_PARA_00001 text"',
    '"change_type":"add_comment_only","add_comment":"look here","confidence":"low"',
    '"change_type":"reply_to_comment","add_comment":"answered"',
    '"change_type":"accept_revision"',
    '"change_type":"reject_revision"',
    '"change_type":"replace_text","old_text":"Order","new_text":"Sale","apply_change":false',
    '"change_type":"accept_revision"',
    '"change_type":"reject_revision"',
]


def _inputs(spark, sf_dir):
    k = F.col("o_orderkey")
    doc, place = F.floor(k / 64), (k % 64).cast("int")
    orders = table(spark, sf_dir, "orders").select(doc.alias("doc_id"), place.alias("place"), k.alias("k"), F.concat(F.lit("Order "), k.cast("string"), F.lit(" — “"), "o_orderpriority", F.lit("” status "), "o_orderstatus", F.lit(" for customer "), F.col("o_custkey").cast("string")).alias("text"), F.col("o_custkey").cast("string").alias("who"))
    anchor = F.format_string("AR_PARA_%05d", F.col("place") + 1)
    paragraphs = orders.filter("k % 13 != 5").select("doc_id", anchor.alias("anchor"), "text")
    comments = orders.filter("place % 4 = 0").select("doc_id", (F.floor(F.col("place") / 4) + 1).alias("ordinal"), F.col("who").alias("author"), F.lit("why?").alias("text"), anchor.alias("anchor"))
    each = F.explode(F.sequence(F.lit(1), F.lit(2)))
    revisions = orders.filter("place % 2 = 0").withColumn("j", each).select("doc_id", F.format_string("AR_REV_%05d", F.col("place") + F.col("j")).alias("anchor"), anchor.alias("paragraph"), F.when(F.col("j") == 1, "ins").otherwise("del").alias("kind"), F.col("who").alias("author"), F.lit("word").alias("text"))
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    shape = ((F.col("l_partkey") + F.col("n")) % len(_SHAPES)).cast("int")
    place = (F.col("l_orderkey") % 64).cast("int")
    target = F.when(shape == 9, F.concat(F.lit("AR_COMMENT_"), (F.col("l_suppkey") % 20).cast("string"))).when(shape >= 13, F.format_string("AR_REV_%05d", place + 1 + F.col("n") % 2)).otherwise(F.format_string("AR_PARA_%05d", place + 1))
    line = F.concat(F.lit('{"bookmark_id":"'), target, F.lit('",'), F.element_at(F.array(*[F.lit(s) for s in _SHAPES]), shape + 1), F.lit("}"))
    lines = items.select(F.floor(F.col("l_orderkey") / 64).alias("doc_id"), (F.col("l_orderkey") % 64 * 100 + F.col("n")).alias("line_no"), line.alias("line"))
    return lines, paragraphs, comments, revisions


def _applied(spark, sf_dir):
    return P.apply_edits(*_inputs(spark, sf_dir))


def applied_lines(spark, sf_dir):
    return _applied(spark, sf_dir).plan


def applied_texts(spark, sf_dir):
    return _applied(spark, sf_dir).paragraphs


def applied_comments(spark, sf_dir):
    return _applied(spark, sf_dir).comments


def applied_revisions(spark, sf_dir):
    return _applied(spark, sf_dir).revisions


def applied_footnotes(spark, sf_dir):
    return _applied(spark, sf_dir).footnotes


@lru_cache
def _base() -> str:
    """The inputs, then each paragraph's text edit by edit in a recursive query; pieces and places are written out by shape."""
    norm = "translate(text, '—“”', '-\"\"')"
    return f"""
WITH RECURSIVE paras AS (
  SELECT o_orderkey AS k, o_orderkey // 64 AS doc_id, o_orderkey % 64 AS place, printf('AR_PARA_%05d', o_orderkey % 64 + 1) AS anchor, o_custkey::VARCHAR AS who, o_orderkey % 13 != 5 AS there,
         'Order ' || o_orderkey || ' — “' || o_orderpriority || '” status ' || o_orderstatus || ' for customer ' || o_custkey AS text FROM orders),
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
lines AS (
  SELECT l_orderkey // 64 AS doc_id, l_orderkey AS k, l_orderkey % 64 * 100 + n AS line_no, (l_partkey + n) % {len(_SHAPES)} AS s, l_suppkey % 20 AS c, l_orderkey % 64 + 1 + n % 2 AS rev FROM items),
aimed AS (
  SELECT l.*, p.there, CASE WHEN s = 9 THEN 'AR_COMMENT_' || c WHEN s >= 13 THEN printf('AR_REV_%05d', rev) ELSE p.anchor END AS anchor, p.place,
    CASE WHEN s = 12 THEN 'APPLY_FALSE'
         WHEN s = 9 THEN CASE WHEN EXISTS (SELECT 1 FROM paras q WHERE q.doc_id = l.doc_id AND q.place % 4 = 0 AND q.place // 4 + 1 = l.c) THEN '' ELSE 'TARGET_NOT_FOUND' END
         WHEN s >= 13 THEN CASE WHEN EXISTS (SELECT 1 FROM paras q WHERE q.doc_id = l.doc_id AND q.place % 2 = 0 AND (q.place + 1 = l.rev OR q.place + 2 = l.rev)) THEN '' ELSE 'TARGET_NOT_FOUND' END
         WHEN there THEN '' ELSE 'TARGET_NOT_FOUND' END AS why
  FROM lines l JOIN paras p ON p.k = l.k),
edits AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line_no) AS step FROM aimed WHERE s <= 7 AND why = ''),
fold(k, step, line_no, s, text, notes, failed, start, cut, put) AS (
  SELECT k, 0, NULL::BIGINT, -1, text, []::STRUCT(line_no BIGINT, place BIGINT, body VARCHAR)[], NULL::VARCHAR, 0::BIGINT, '', '' FROM paras WHERE there
  UNION ALL
  SELECT k, step, line_no, s, CASE WHEN failed IS NULL THEN substr(text, 1, start) || put || substr(text, start + length(cut) + 1) ELSE text END,
    CASE WHEN failed IS NOT NULL THEN notes
         WHEN s IN (4, 5) THEN list_append(notes, {{'line_no': line_no, 'place': start, 'body': CASE s WHEN 4 THEN 'note here' ELSE 'at customer' END}})
         ELSE list_transform(notes, lambda x: {{'line_no': x.line_no, 'place': CASE WHEN x.place >= start + length(cut) THEN x.place + length(put) - length(cut) WHEN x.place > start THEN start + length(put) ELSE x.place END, 'body': x.body}}) END,
    failed, start, cut, put
  FROM (
    SELECT k, step, line_no, s, text, notes,
      CASE WHEN s IN (0, 1, 2, 3, 5) AND found = 0 THEN 'OLD_TEXT_NOT_FOUND' WHEN s = 7 AND text = 'Rewritten text' THEN 'NO_CHANGE' END AS failed,
      CASE s WHEN 0 THEN found + 3 WHEN 1 THEN found - 1 WHEN 2 THEN found + 1 WHEN 4 THEN length(text) WHEN 5 THEN found + 7 ELSE 0 END::BIGINT AS start,
      CASE s WHEN 0 THEN 'us' WHEN 1 THEN 'state' WHEN 6 THEN text WHEN 7 THEN text ELSE '' END AS cut,
      CASE s WHEN 0 THEN 'e' WHEN 1 THEN 'condition of' WHEN 2 THEN 'the ' WHEN 7 THEN 'Rewritten text' ELSE '' END AS put
    FROM (SELECT f.k, e.step, e.line_no, e.s, f.text, f.notes, CASE e.s WHEN 0 THEN strpos({norm}, 'status') WHEN 1 THEN strpos({norm}, 'state') WHEN 2 THEN strpos({norm}, '- "') WHEN 3 THEN strpos({norm}, 'absent') WHEN 5 THEN strpos({norm}, 'customer') ELSE 1 END AS found
          FROM fold f JOIN edits e ON e.k = f.k AND e.step = f.step + 1))),
last AS (SELECT k, arg_max(text, step) AS text, arg_max(notes, step) AS notes FROM fold GROUP BY k),
tracked AS (
  SELECT doc_id, printf('AR_REV_%05d', place + j) AS anchor, anchor AS paragraph, CASE j WHEN 1 THEN 'ins' ELSE 'del' END AS kind, who AS author, 'word' AS text, NULL::BIGINT AS line_no FROM paras, (VALUES (1), (2)) AS v(j) WHERE place % 2 = 0
  UNION ALL SELECT doc_id, NULL, anchor, 'del', '{P.AUTHOR}', cut, line_no FROM fold JOIN paras USING (k) WHERE step > 0 AND failed IS NULL AND cut != ''
  UNION ALL SELECT doc_id, NULL, anchor, 'ins', '{P.AUTHOR}', put, line_no FROM fold JOIN paras USING (k) WHERE step > 0 AND failed IS NULL AND put != ''
  UNION ALL SELECT doc_id, NULL, anchor, 'footnote', '{P.AUTHOR}', CASE s WHEN 4 THEN 'note here' ELSE 'at customer' END, line_no FROM fold JOIN paras USING (k) WHERE step > 0 AND failed IS NULL AND s IN (4, 5)),
verdicts AS (SELECT doc_id, anchor, line_no, CASE WHEN s IN (10, 13) THEN 'accepted' ELSE 'rejected' END AS state FROM aimed WHERE s IN (10, 11, 13, 14) AND why = ''),
settled AS (
  SELECT t.*, coalesce((SELECT arg_min(v.state, v.line_no) FROM verdicts v WHERE v.doc_id = t.doc_id AND (v.anchor = t.anchor OR v.anchor = t.paragraph)), 'pending') AS state,
    (SELECT min(v.line_no) FROM verdicts v WHERE v.doc_id = t.doc_id AND (v.anchor = t.anchor OR v.anchor = t.paragraph)) AS decided_by FROM tracked t),
final AS (
  SELECT p.k, p.doc_id, p.anchor, l.notes, coalesce(v.state = 'rejected', false) AS back, CASE WHEN v.state = 'rejected' THEN p.text ELSE l.text END AS text
  FROM paras p JOIN last l ON l.k = p.k LEFT JOIN (SELECT doc_id, anchor, arg_min(state, line_no) AS state FROM verdicts GROUP BY ALL) v ON v.doc_id = p.doc_id AND v.anchor = p.anchor),
told AS (
  SELECT a.doc_id, a.k, a.s, a.c, a.line_no, CASE WHEN a.s IN (10, 11, 13, 14) THEN 2 ELSE 1 END AS pass_no, a.anchor,
    CASE WHEN a.why != '' THEN a.why WHEN f.failed IS NOT NULL THEN f.failed WHEN a.s IN (10, 11, 13, 14) AND NOT EXISTS (SELECT 1 FROM settled x WHERE x.doc_id = a.doc_id AND x.decided_by = a.line_no) THEN 'NO_REVISIONS' ELSE '' END AS why
  FROM aimed a LEFT JOIN fold f ON f.k = a.k AND f.line_no = a.line_no)"""


_PLAN = """ SELECT t.doc_id, t.line_no, t.pass_no, CASE WHEN why = '' THEN 'Applied' ELSE 'Skipped' END AS status, why, t.anchor, CASE WHEN why = '' THEN f.text END AS text_after
FROM told t LEFT JOIN final f ON f.doc_id = t.doc_id AND f.anchor = t.anchor"""
_COMMENTS = f""", spoken AS (
  SELECT t.doc_id, CASE WHEN s = 9 THEN c END AS parent, CASE s WHEN 1 THEN '[AR High] wording' WHEN 6 THEN '[AR Medium] gone' WHEN 8 THEN '[AR Low] look here' ELSE '[AR Medium] answered' END AS text,
    CASE WHEN s = 9 THEN printf('AR_PARA_%05d', (c - 1) * 4 + 1) ELSE anchor END AS anchor, line_no FROM told t WHERE why = '' AND s IN (1, 6, 8, 9)),
had AS (SELECT doc_id, place // 4 + 1 AS ordinal, who, anchor FROM paras WHERE place % 4 = 0)
SELECT doc_id, ordinal, NULL::BIGINT AS parent, who AS author, 'why?' AS text, anchor, NULL::BIGINT AS line_no FROM had
UNION ALL SELECT s.doc_id, coalesce(h.last, 0) + row_number() OVER (PARTITION BY s.doc_id ORDER BY line_no, text), parent, '{P.AUTHOR}', text, anchor, line_no FROM spoken s LEFT JOIN (SELECT doc_id, max(ordinal) AS last FROM had GROUP BY 1) h ON h.doc_id = s.doc_id"""

QUERIES = {
    "applied_lines": (applied_lines, _base() + _PLAN),
    "applied_texts": (applied_texts, _base() + " SELECT doc_id, anchor, text FROM final"),
    "applied_comments": (applied_comments, _base() + _COMMENTS),
    "applied_revisions": (applied_revisions, _base() + " SELECT * FROM settled"),
    "applied_footnotes": (applied_footnotes, _base() + " SELECT doc_id, anchor, x.place::INTEGER AS \"at\", x.body AS body, x.line_no AS line_no FROM (SELECT doc_id, anchor, unnest(notes) AS x FROM final WHERE NOT back)"),
}
