"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.fingerprint import fingerprint_points, fingerprint_sql
from leafmark.plans.inputs import TYPESET, table, texts, typeset

# the same white space, characters and marks in the oracle's dialect
_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PLAIN = "translate({0}, '\u2014\u2013\u2015\u2212\u2011\u201c\u201d\u2018\u2019\u00a0', '-----\"\"'''' ')"
_ILLEGAL = "'\\/:*?\"<>|', '_________'"


def _fingerprint_sql_of(column: str, table_: str, key: str) -> str:
    return f"""
WITH u AS (SELECT {key}, list_transform(string_split({column}, ''), lambda c, i: ord(c)) AS c FROM (SELECT {key}, coalesce({column}, '') AS {column} FROM {table_})),
v AS (SELECT {key}, CASE WHEN len(c) = 1 AND c[1] = 0 THEN [] ELSE c END AS c FROM u),
h AS (SELECT {key}, list_reduce(list_concat([18652614::BIGINT], c::BIGINT[]), lambda a, x: (a * 131 + x + 1) % 2147483647) AS a,
      list_reduce(list_concat([1099511628::BIGINT], list_transform(c::BIGINT[], lambda x, i: x + i % 251)), lambda a, x: (a * 137 + x + 1) % 2147483629) AS b FROM v)
SELECT {key}, printf('%08X%08X', a, b) AS fingerprint FROM h"""


def fingerprint_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", fingerprint_points(F.col("text")).alias("fingerprint"))


def fingerprint_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fingerprint_sql(F.col("c_name")).alias("fingerprint"))


def normalize_text(spark, sf_dir):
    t = F.col("text")
    return typeset(spark, sf_dir).select("doc_id", T.normalize_punctuation(t).alias("plain"), T.normalize_newlines(t).alias("unix"), T.trim_ws(t).alias("trimmed"))


NORMALIZE_TEXT = f"WITH {TYPESET} SELECT doc_id, {_PLAIN.format('text')} AS plain, replace(text, chr(13) || chr(10), chr(10)) AS unix, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS trimmed FROM typeset"


def clean_one_line(spark, sf_dir):
    return typeset(spark, sf_dir).select("doc_id", T.clean_one_line(F.col("text")).alias("line"))


CLEAN_ONE_LINE = f"WITH {TYPESET} SELECT doc_id, trim(regexp_replace(translate({_PLAIN.format('text')}, chr(13) || chr(10), '  '), ' {{2,}}', ' ', 'g')) AS line FROM typeset"


def strip_anchor_tokens(spark, sf_dir):
    return typeset(spark, sf_dir).select("doc_id", T.strip_anchor_tokens(F.col("text")).alias("bare"))


STRIP_ANCHORS = f"WITH {TYPESET} SELECT doc_id, regexp_replace(regexp_replace(text, 'AR_[A-Za-z]+(_[A-Za-z0-9]+)+', '', 'g'), ' {{2,}}', ' ', 'g') AS bare FROM typeset"


def json_escape(spark, sf_dir):
    return typeset(spark, sf_dir).select("doc_id", T.json_escape(F.col("text")).alias("escaped"))


JSON_ESCAPE = f"""WITH {TYPESET} SELECT doc_id, replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(13), '\\n'), chr(10), '\\n'), chr(9), '\\t') AS escaped FROM typeset"""


def file_names(spark, sf_dir):
    url = F.col("url")
    path = F.concat(F.lit("C:\\in\\"), F.replace(url, F.lit("/"), F.lit("\\")), F.when(F.col("page_id") % 2 == 0, "_AR.docx").otherwise(" .DOCX"))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_token(url).alias("token"), T.file_base_name(path).alias("base_name"), T.working_copy_path(path).alias("working_copy"), T.is_docx_name(path).alias("is_docx"), T.document_base_name(path).alias("document"))


FILE_NAMES = rf"""
WITH p AS (SELECT page_id, url, 'C:\in\' || replace(url, '/', '\') || CASE WHEN page_id % 2 = 0 THEN '_AR.docx' ELSE ' .DOCX' END AS path FROM pages),
q AS (SELECT *, regexp_extract(path, '([^\\]*)$', 1) AS name FROM p),
r AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '(\.[^.]*)$', 1) AS ext FROM q)
SELECT page_id, nullif(trim(translate(translate(trim(url), chr(13) || chr(10) || chr(9), ''), {_ILLEGAL})), '') AS token,
       coalesce(nullif(regexp_replace(translate(stem, {_ILLEGAL}), '[ .]+$', ''), ''), 'Export') AS base_name,
       substr(path, 1, length(path) - length(name)) || stem || CASE WHEN ends_with(stem, '_AR') THEN '' ELSE '_AR' END || ext AS working_copy,
       regexp_matches(path, '(?i)\.docx$') AS is_docx, regexp_replace(path, '(?i)\.docx$', '') AS document FROM r"""


def slugs(spark, sf_dir):
    date = F.when(F.col("c_custkey") % 3 != 0, F.lit("2026-05-14"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.slugify(F.col("c_name")).alias("slug"), T.slice_filename(F.concat("c_name", F.lit(" (draft)")), F.col("c_mktsegment"), date).alias("slice_file"))


SLUGS = r"""
WITH s AS (SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim(c_name || ' (draft)')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS doc,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS who FROM customer)
SELECT c_custkey, slug, doc || '_' || who || '_' || CASE WHEN c_custkey % 3 != 0 THEN '2026-05-14' ELSE 'undated' END || '.md' AS slice_file FROM s"""


def word_token_estimates(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", T.word_count(t).cast("long").alias("words"), T.estimated_tokens(t).alias("tokens"), (T.word_count(t) > T.CHUNK_WORDS).alias("needs_chunks"))


WORDS = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{_SPACE.replace("[", "[^", 1)}+')) AS words FROM documents)
SELECT doc_id, words::BIGINT AS words, ceil(length(text) / 4)::BIGINT AS tokens, words > 12000 AS needs_chunks FROM w"""


def confidence_levels(spark, sf_dir):
    k = F.col("o_orderkey") % 8
    raw = F.element_at(F.array(*[F.lit(x) for x in ("HIGH", " h ", "Med", "m", "medium", "L", "low ", "?")]), (k + 1).cast("int"))
    default = F.when(F.col("o_orderkey") % 3 == 0, " High").when(F.col("o_orderkey") % 3 == 1, "LOW").otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_confidence(raw, default).alias("confidence"))


CONFIDENCE = """
WITH r AS (SELECT o_orderkey, lower(trim(['HIGH', ' h ', 'Med', 'm', 'medium', 'L', 'low ', '?'][o_orderkey % 8 + 1])) AS raw, lower(trim([' High', 'LOW', 'none'][o_orderkey % 3 + 1])) AS def FROM orders)
SELECT o_orderkey, CASE WHEN raw IN ('high', 'h') THEN 'High' WHEN raw IN ('medium', 'med', 'm') THEN 'Medium' WHEN raw IN ('low', 'l') THEN 'Low'
  WHEN def = 'high' THEN 'High' WHEN def = 'low' THEN 'Low' ELSE 'Medium' END AS confidence FROM r"""


def csv_items(spark, sf_dir):
    s = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.split_csv(s)).alias("place", "item")).withColumn("place", F.col("place").cast("long"))


CSV_ITEMS = """
WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' , ,') || ', ' || p_brand, ','), lambda x: trim(x)), lambda x: x != '') AS l FROM part)
SELECT p_partkey, i - 1 AS place, l[i] AS item FROM s, unnest(range(1, len(l) + 1)) AS u(i)"""


def date_labels(spark, sf_dir):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    iso = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(iso)
    return table(spark, sf_dir, "events").select("event_id", T.format_date(iso).alias("day"), T.format_window(iso).alias("minute"))


DATE_LABELS = r"""
WITH i AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END END AS iso FROM events)
SELECT event_id, CASE WHEN instr(iso, 'T') > 1 THEN string_split(iso, 'T')[1] ELSE iso END AS day, regexp_replace(iso, '^(.*T\d{2}:\d{2}):\d{2}(Z?)$', '\1\2') AS minute FROM i"""


def excerpts(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    a = F.floor(n / 3).cast("int")
    return texts(spark, sf_dir).select("doc_id", T.excerpt(t).alias("head"), T.context(t, a, a + 10).alias("around"))


EXCERPTS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, length(coalesce(text, '')) // 3 AS a FROM documents),
u AS (SELECT *, greatest(a - 80, 0) AS s, least(a + 90, n) AS e FROM t)
SELECT doc_id, CASE WHEN n > 60 THEN substr(text, 1, 60) || '\u2026' ELSE text END AS head,
       CASE WHEN s > 0 THEN '\u2026' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < n THEN '\u2026' ELSE '' END AS around FROM u"""


def containing_sentences(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.containing_sentence(F.col("text"), F.floor(F.length("text") / 2)).alias("sentence"))


SENTENCES = rf"""
WITH t AS (SELECT doc_id, substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) AS b, substr(coalesce(text, ''), length(coalesce(text, '')) // 2 + 1) AS a FROM documents),
u AS (SELECT doc_id, regexp_replace(b, '(?s)^.*[.!?]{_SPACE}+', '') AS head, CASE WHEN regexp_matches(a, '(?s)[.!?](?:{_SPACE}|$)') THEN regexp_extract(a, '(?s)^(.*?[.!?])(?:{_SPACE}|$)', 1) ELSE a END AS tail FROM t)
SELECT doc_id, regexp_replace(head || tail, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS sentence FROM u"""


def emphasis_marks(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.concat(F.when(k % 2 == 0, "  ").otherwise(""), F.col("p_name"), F.when(k % 3 == 0, "\n").otherwise(""))
    s = F.when(k % 10 == 9, F.lit("   ")).otherwise(s)
    return table(spark, sf_dir, "part").select("p_partkey", T.emphasis(s, k % 4 < 2, k % 4 % 2 == 0).alias("marked"))


EMPHASIS = """
WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE p_name END AS core, CASE WHEN p_partkey % 10 = 9 THEN '   ' WHEN p_partkey % 2 = 0 THEN '  ' ELSE '' END AS lead,
  CASE WHEN p_partkey % 10 != 9 AND p_partkey % 3 = 0 THEN chr(10) ELSE '' END AS trail, CASE WHEN p_partkey % 4 < 2 THEN '**' ELSE '' END AS b, CASE WHEN p_partkey % 4 % 2 = 0 THEN '*' ELSE '' END AS i FROM part)
SELECT k AS p_partkey, lead || CASE WHEN core = '' THEN '' ELSE b || i || core || i || b END || trail AS marked FROM s"""


def anchor_classes(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("PARA", "CELL", "FN", "REV", "COMMENT")]), (k % 5 + 1).cast("int"))
    anchor = F.format_string("AR_%s_%05d", kind, k)
    line = F.concat(F.lit("  ["), (k % 9).cast("string"), F.lit("] "), F.when(k % 4 == 0, "Bookmark: ").when(k % 4 == 1, "BOOKMARK:").when(k % 4 == 2, "ACTION: ").otherwise("bookmark:  "), F.when(k % 8 == 3, "").otherwise(anchor))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.anchor_class(anchor).alias("kind"), T.ratified_anchor(line).alias("ratified"))


ANCHOR_CLASSES = """
WITH a AS (SELECT o_orderkey AS k, printf('AR_%s_%05d', ['PARA', 'CELL', 'FN', 'REV', 'COMMENT'][o_orderkey % 5 + 1], o_orderkey) AS anchor FROM orders)
SELECT k AS o_orderkey, ['paragraph', 'table_cell', 'footnote', 'other', 'other'][k % 5 + 1] AS kind, CASE WHEN k % 4 != 2 AND k % 8 != 3 THEN anchor END AS ratified FROM a"""


def audit_hashes(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.sha256_tag(F.col("text")).alias("source_sha256"))


def part_checksums(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.crc32(F.coalesce("html", F.lit(""))).alias("crc32"))


#: CRC-32 byte by byte, with a table made from its polynomial.
CHECKSUMS = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))) AS t),
bytes AS (SELECT page_id, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::UBIGINT) AS b FROM (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages))
SELECT page_id, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(t[(xor(c, x) & 255::UBIGINT)::INTEGER + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS crc32 FROM bytes, steps"""


QUERIES = {
    "fingerprint_documents": (fingerprint_documents, _fingerprint_sql_of("text", "documents", "doc_id")),
    "fingerprint_names": (fingerprint_names, _fingerprint_sql_of("c_name", "customer", "c_custkey")),
    "normalize_text": (normalize_text, NORMALIZE_TEXT),
    "clean_one_line": (clean_one_line, CLEAN_ONE_LINE),
    "strip_anchor_tokens": (strip_anchor_tokens, STRIP_ANCHORS),
    "json_escape": (json_escape, JSON_ESCAPE),
    "file_names": (file_names, FILE_NAMES),
    "slugs": (slugs, SLUGS),
    "word_token_estimates": (word_token_estimates, WORDS),
    "confidence_levels": (confidence_levels, CONFIDENCE),
    "csv_items": (csv_items, CSV_ITEMS),
    "date_labels": (date_labels, DATE_LABELS),
    "excerpts": (excerpts, EXCERPTS),
    "containing_sentences": (containing_sentences, SENTENCES),
    "emphasis_marks": (emphasis_marks, EMPHASIS),
    "anchor_classes": (anchor_classes, ANCHOR_CLASSES),
    "audit_hashes": (audit_hashes, "SELECT doc_id, 'sha256-' || sha256(coalesce(text, '')) AS source_sha256 FROM documents"),
    "part_checksums": (part_checksums, CHECKSUMS),
}
