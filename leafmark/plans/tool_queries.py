"""SQL table functions, labelled answers, and spreadsheet cells over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.functions import tables as T
from leafmark.operators import labels as L
from leafmark.operators import sheets as S
from leafmark.plans.edit_queries import FIELDS, PAYLOAD, _edit_lines, _payload
from leafmark.plans.inputs import table
from leafmark.plans.markup_queries import TOKENS, _marked


def sql_markup_tokens(spark, sf_dir):
    """`markup_tokens` by its SQL table function."""
    T.register(spark)
    rows = _marked(spark, sf_dir)
    return spark.sql("SELECT d.doc_id, t.edit_id, t.type, t.raw_start, t.raw_end, t.md_start, t.md_end FROM {docs} d, LATERAL markup_tokens(d.marked) t", docs=rows)


def sql_edit_fields(spark, sf_dir):
    """`jsonl_fields` by its SQL table function."""
    T.register(spark)
    return spark.sql("SELECT l.line_no, e.bookmark_id, e.change_type, e.old_text, e.new_text, e.add_comment, e.confidence, e.apply_change FROM {lines} l, LATERAL edit_line(l.line) e", lines=_edit_lines(spark, sf_dir))


def sql_payload_lines(spark, sf_dir):
    """`payload_filter` by a table function over the partitions of documents."""
    T.register(spark)
    _payload(spark, sf_dir).createOrReplaceTempView("leafmark_payload")
    return spark.sql("SELECT * FROM payload_lines(TABLE(SELECT doc_id, line_no, line FROM leafmark_payload) PARTITION BY doc_id ORDER BY line_no)")


#: Answers by key, each with its code where it is the label's first.
_ANSWERS = [
    ("[C{n}] reply: Agreed — see | recommend: resolve", ""),
    ("[R{n}] recommend: Accept | rationale: fits {k}", ""),
    ("[C{n}] reply: noted", ""),
    ("[R{n}] recommend: maybe", "UNKNOWN_RECOMMENDATION"),
    ("[R{n}] reply: no", "FIELD_NOT_ALLOWED"),
    ("[C{n}] reply: a | reply: b", "MALFORMED"),
    ("no label {n}", "MALFORMED"),
    ("[R{n}] rationale: only", "RECOMMENDATION_MISSING"),
    ("[C{n}] reply:", "NOTHING_SAID"),
    ("[R0{n}] recommend: reject", ""),
]


def _answers(spark, sf_dir):
    """Line items as answers to labels C0 to C4 and R0 to R4 of their order; C4 and R4 aren't there, and C0 of even orders is answered."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber") % 5
    shape = F.element_at(F.array(*[F.lit(a) for a, _ in _ANSWERS]), ((F.col("l_partkey") + F.col("l_suppkey")) % len(_ANSWERS) + 1).cast("int"))
    line = F.replace(F.replace(shape, F.lit("{n}"), n.cast("string")), F.lit("{k}"), F.col("l_suppkey").cast("string"))
    place = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(k.alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("payload_no"), place.alias("line_no"), line.alias("line")).distinct()
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    targets = ids.select("doc_id", F.explode(F.array(*[F.lit(f"{kind}{i}") for kind in "CR" for i in range(4)])).alias("label"))
    return lines, targets, ids.filter("doc_id % 2 = 0").select("doc_id", F.lit("C0").alias("label"))


def answered_labels(spark, sf_dir):
    return L.answer(*_answers(spark, sf_dir)).plan


def answered_comments(spark, sf_dir):
    return L.answer(*_answers(spark, sf_dir)).comments


def answered_twice(spark, sf_dir):
    """The same payload again, after what it addressed was kept: how many lines change something, per code."""
    lines, targets, before = _answers(spark, sf_dir)
    rows = L.checked(lines, targets)
    again = L.answered(rows, before.unionByName(L.answered(rows, before).addressed))
    return again.plan.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _answers_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("{n}", "' || n || '").replace("{k}", "' || sk || '") + "'"

    lines = " ".join(f"WHEN {i} THEN {quoted(a)}" for i, (a, _) in enumerate(_ANSWERS))
    return f"""
WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 2 AS payload_no, l_partkey * 1000 + l_suppkey AS line_no, l_linenumber % 5 AS n, (l_partkey + l_suppkey) % {len(_ANSWERS)} AS s, l_suppkey AS sk FROM lineitem),
l AS (SELECT *, CASE s {lines} END AS line, CASE WHEN s IN (0, 2, 5, 8) THEN 'C' || n WHEN s != 6 THEN 'R' || n ELSE '' END AS label FROM i),
c AS (SELECT *, CASE WHEN s IN (5, 6) THEN 'MALFORMED' WHEN n = 4 THEN 'UNKNOWN_LABEL' ELSE CASE s {' '.join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_ANSWERS))} END END AS code FROM l),
f AS (SELECT doc_id, label, min((payload_no, line_no, line)) AS first FROM c WHERE code = '' AND NOT (doc_id % 2 = 0 AND label = 'C0') GROUP BY ALL),
plan AS (
  SELECT c.doc_id, payload_no, line_no, c.label, CASE s WHEN 0 THEN 'Agreed — see' WHEN 2 THEN 'noted' WHEN 4 THEN 'no' WHEN 5 THEN 'a' WHEN 8 THEN '' END AS reply,
    CASE s WHEN 0 THEN 'resolve' WHEN 1 THEN 'accept' WHEN 3 THEN 'maybe' WHEN 9 THEN 'reject' END AS recommend, CASE s WHEN 1 THEN 'fits ' || sk WHEN 7 THEN 'only' END AS rationale,
    CASE WHEN code = '' AND (f.first IS NULL OR f.first != (payload_no, line_no, line)) THEN 'ALREADY_ADDRESSED' ELSE code END AS code
  FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.label = c.label)"""


_MONTHS = ["Jan", "Feb", "Mar"]


def _cells(spark, sf_dir):
    """A JSON cell per line item: region and three months, some of them missing, some cells blank or broken."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    one = F.to_json(F.struct(F.col("l_returnflag").alias("Region"), F.col("l_quantity").alias("Jan"), F.when(k % 4 != 0, F.col("l_quantity") * 2 + F.col("l_suppkey") % 7).alias("Feb"), (F.col("l_linenumber") * 10).cast("double").alias("Mar")))
    cell = F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(one, F.lit("x"))).otherwise(F.concat(F.lit(" "), one))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_no"), cell.alias("json_line"))


def _sheet(spark, sf_dir):
    return S.records(_cells(spark, sf_dir), [("Region", "string"), *((m, "double") for m in _MONTHS)]).filter("not _error")


def sheet_totals(spark, sf_dir):
    """Cells to rows, wide to long, a name looked up, then sums per region and month."""
    names = spark.createDataFrame([("A", "Accepted"), ("R", "Returned"), ("R", "Zero")], "Region string, Name string")
    long = S.melt(_sheet(spark, sf_dir), ["Region"], _MONTHS, "Month", "Throughput")
    return S.looked_up(long, names, "Region", ["Name"]).groupBy("Region", "Name", "Month").agg(F.sum("Throughput").alias("total"), F.count("Throughput").alias("n"))


def sheet_summary(spark, sf_dir):
    rows = S.describe(_sheet(spark, sf_dir), _MONTHS)
    return rows.select("variable", "count", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def sheet_correlations(spark, sf_dir):
    return S.correlations(_sheet(spark, sf_dir), _MONTHS).select("x", "y", F.round("r", 6).alias("r"))


_SHEET = """
WITH sheet AS (
  SELECT l_returnflag AS Region, l_quantity AS Jan, CASE WHEN (l_orderkey + l_partkey) % 4 != 0 THEN l_quantity * 2 + l_suppkey % 7 END AS Feb, l_linenumber * 10.0 AS Mar
  FROM lineitem WHERE (l_orderkey + l_partkey) % 11 != 0 AND (l_orderkey + l_partkey) % 13 != 0),
long AS (SELECT Region, unnest(['Jan', 'Feb', 'Mar']) AS variable, unnest([Jan, Feb, Mar]::DOUBLE[]) AS value FROM sheet)"""

QUERIES = {
    "sql_markup_tokens": (sql_markup_tokens, TOKENS),
    "sql_edit_fields": (sql_edit_fields, FIELDS),
    "sql_payload_lines": (sql_payload_lines, PAYLOAD),
    "answered_labels": (answered_labels, _answers_sql() + " SELECT * FROM plan"),
    "answered_comments": (answered_comments, _answers_sql() + " SELECT doc_id, label, CASE WHEN label LIKE 'C%' THEN reply ELSE 'Recommended: ' || recommend || coalesce(' — ' || rationale, '') END AS text, label LIKE 'C%' AS threaded FROM plan WHERE code = ''"),
    "answered_twice": (answered_twice, _answers_sql() + " SELECT CASE code WHEN '' THEN 'ALREADY_ADDRESSED' ELSE code END AS code, count(*) AS n FROM plan GROUP BY 1"),
    "sheet_totals": (sheet_totals, _SHEET + " SELECT Region, CASE Region WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' END AS Name, variable AS Month, sum(value) AS total, count(value) AS n FROM long GROUP BY ALL"),
    "sheet_summary": (sheet_summary, _SHEET + " SELECT variable, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM long GROUP BY 1"),
    "sheet_correlations": (sheet_correlations, _SHEET + "".join(f" {'UNION ALL ' if i else ''}SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM sheet" for i, (x, y) in enumerate((x, y) for x in _MONTHS for y in _MONTHS))),
}
