"""Chunked validation: documents as exports with a top heading every third paragraph, one response per chunk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmark.operators import chunked as C
from leafmark.plans.inputs import lines

HEADER = "<!-- export {++legend++} -->"


def _inputs(spark, sf_dir):
    """A response's fault follows from document and chunk: altered text, nesting, none given; protected and uncovered places later."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kept = lines(spark, sf_dir).filter(F.trim("line") != "").withColumn("i", F.row_number().over(order) - 1)
    shown = kept.withColumn("shown", F.when(F.col("i") % 3 == 0, F.concat(F.lit("# "), F.ltrim("line"))).otherwise(F.col("line")))
    ids = lines(spark, sf_dir).select("doc_id").distinct()
    joined = shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "shown"))), lambda x: x["shown"]), "\n\n").alias("body"))
    exports = ids.join(joined, "doc_id", "left").select("doc_id", F.concat(F.lit(HEADER), F.coalesce(F.concat(F.lit("\n\n"), "body"), F.lit(""))).alias("exported"))
    i = F.col("i")
    sizes = lines(spark, sf_dir).filter(F.trim("line") != "").select("doc_id", "line_no", F.length("line").alias("n"), F.length(F.ltrim("line")).alias("bare"))  # places need no texts
    sized = sizes.withColumn("i", F.row_number().over(order) - 1).select("doc_id", "line_no", "i", F.when(i % 3 == 0, F.col("bare") + 2).otherwise(F.col("n")).alias("n"))
    start = len(HEADER) + 2 + F.coalesce(F.sum(F.col("n") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sized.select("doc_id", i.alias("block_seq"), F.when(i % 3 == 0, "heading").otherwise("p").alias("kind"), start.cast("long").alias("md_start"), (start + F.col("n")).cast("long").alias("md_end"))
    chunk = F.floor(F.col("block_seq") / 3)
    heads = blocks.filter("kind = 'heading'").withColumn("k", F.col("doc_id") + chunk)
    prefix = F.when(F.col("kind") == "heading", 2).otherwise(0)
    runs = blocks.filter(~((F.col("kind") == "heading") & ((F.col("doc_id") + chunk) % 9 == 5))).select("doc_id", "block_seq", F.lit(0).alias("run_index"), (F.col("md_start") + prefix).alias("md_start"), "md_end", F.lit(0).alias("char_offset"))
    locked = heads.filter("k % 5 = 3").select("doc_id", F.col("md_start").alias("s"), F.col("md_end").alias("e"))
    pieces, _ = C.split(exports, blocks)
    k, off = F.col("doc_id") * 7 + F.col("chunk_index"), F.when(F.col("chunk_index") > 0, 2).otherwise(F.least(F.lit(len(HEADER) + 4), F.length("exported")))
    put = F.when(k % 41 == 2, "{++a{--b--}++}").otherwise("{++new ++}")
    response = F.concat(F.substring(F.col("exported"), F.lit(1), off), put, F.substring(F.col("exported"), off + 1, F.length("exported")), F.when(k % 37 == 1, "x").otherwise(""))
    responses = pieces.filter(k % 43 != 4).select("doc_id", "chunk_index", response.alias("response"))
    return exports, blocks, responses, runs, locked, locked.limit(0)


def chunked_validation(spark, sf_dir):
    return C.check(*_inputs(spark, sf_dir)).verdicts


def chunked_edits(spark, sf_dir):
    return C.check(*_inputs(spark, sf_dir)).edits.select("doc_id", "edit_id", "chunk_index", "type", "raw_start", "md_start", "new_text")


_BASE = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, l[j] AS line FROM split, unnest(range(1, len(l) + 1)) AS u(j) WHERE trim(l[j], ' ') != ''),
shown AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN length(ltrim(line, ' ')) + 2 ELSE length(line) END AS n FROM kept),
placed AS (SELECT *, {len(HEADER) + 2} + coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM shown),
chunks AS (
  SELECT doc_id, i // 3 AS c, CASE WHEN i = 0 THEN {len(HEADER) + 4} ELSE 2 END AS off, s + 2 AS pos, n FROM placed WHERE i % 3 = 0
  UNION ALL SELECT doc_id, 0, {len(HEADER)}, {len(HEADER)}, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
gates AS (
  SELECT *, CASE WHEN (doc_id * 7 + c) % 43 = 4 THEN 'NO_RESPONSE' WHEN (doc_id * 7 + c) % 41 = 2 THEN 'G1' WHEN (doc_id * 7 + c) % 37 = 1 THEN 'G2' END AS one,
    CASE WHEN n > 2 AND (doc_id + c) % 5 = 3 THEN 'G4' WHEN n = 0 OR (doc_id + c) % 9 = 5 THEN 'G3' END AS two FROM chunks),
firsts AS (SELECT doc_id, min(c) FILTER (one IS NOT NULL) AS c1, min(c) FILTER (two IS NOT NULL) AS c2 FROM gates GROUP BY 1)"""

QUERIES = {
    "chunked_validation": (
        chunked_validation,
        _BASE
        + """ SELECT f.doc_id, coalesce(a.one, b.two) AS gate, f.c1::BIGINT AS chunk_index, CASE WHEN a.one = 'G1' THEN a.off END::INTEGER AS at, CASE WHEN f.c1 IS NULL THEN f.c2 END::BIGINT AS edit_id
FROM firsts f LEFT JOIN gates a ON a.doc_id = f.doc_id AND a.c = f.c1 LEFT JOIN gates b ON b.doc_id = f.doc_id AND b.c = f.c2""",
    ),
    "chunked_edits": (
        chunked_edits,
        _BASE + " SELECT g.doc_id, c::BIGINT AS edit_id, c::BIGINT AS chunk_index, 'ins' AS type, off::INTEGER AS raw_start, pos::BIGINT AS md_start, 'new ' AS new_text FROM gates g JOIN firsts f ON f.doc_id = g.doc_id WHERE c1 IS NULL",
    ),
}
