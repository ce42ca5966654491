"""From edit spans to document text: interval joins of edits with blocks, runs and protected spans.

Every join holds the equality of doc_id, so it is a hash or merge join with the overlap as residual.
Tables: edits(doc_id, edit_id, md_start, md_end, ...), runs(doc_id, block_seq, run_index, md_start, md_end, char_offset),
blocks(doc_id, block_seq, md_start, md_end), spans(doc_id, s, e); all half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(edits: DataFrame, others: DataFrame, s: str = "s", e: str = "e") -> Column:
    return (edits["doc_id"] == others["doc_id"]) & (edits["md_start"] < others[e]) & (others[s] < edits["md_end"])


def overlapping_locked(edits: DataFrame, locked: DataFrame) -> DataFrame:
    """Edits that touch a protected span."""
    return edits.join(locked, overlaps(edits, locked), "left_semi")


def crossing_blocks(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edits that lie in more than one block; those without width never do."""
    b = blocks.select(F.col("doc_id").alias("_doc"), F.col("md_start").alias("_s"), F.col("md_end").alias("_e"))
    met = edits.filter("md_end > md_start").join(b, (F.col("doc_id") == F.col("_doc")) & (F.col("md_start") < F.col("_e")) & (F.col("_s") < F.col("md_end")))
    return met.groupBy("doc_id", "edit_id").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")


def resolve_ranges(edits: DataFrame, runs: DataFrame, locked: DataFrame) -> DataFrame:
    """doc_id, edit_id, triples (block_seq, run_index, char_start, char_end), covered, error (locked, synthetic or null)."""
    r = runs.select(F.col("doc_id").alias("_doc"), "block_seq", "run_index", F.col("md_start").alias("_s"), F.col("md_end").alias("_e"), "char_offset")
    met = edits.join(r, (F.col("doc_id") == F.col("_doc")) & (F.col("md_start") < F.col("_e")) & (F.col("_s") < F.col("md_end")), "left")
    s, e = F.greatest("_s", "md_start"), F.least("_e", "md_end")
    start = F.col("char_offset") + s - F.col("_s")
    triple = F.when(F.col("_s").isNotNull(), F.struct("block_seq", "run_index", start.alias("char_start"), (start + e - s).alias("char_end")))
    out = met.groupBy("doc_id", "edit_id", "md_start", "md_end").agg(F.array_sort(F.collect_list(triple)).alias("triples"), F.coalesce(F.sum(F.when(F.col("_s").isNotNull(), e - s)), F.lit(0)).alias("covered"))
    held = overlapping_locked(edits, locked).select("doc_id", "edit_id", F.lit(True).alias("_held")).distinct()
    error = F.when(F.col("_held"), "locked").when(F.col("covered") < F.col("md_end") - F.col("md_start"), "synthetic")
    return out.join(held, ["doc_id", "edit_id"], "left").withColumn("error", error).drop("_held")


def snap(edits: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Edits with their ends moved inward over synthetic spans: snap_start, snap_end.

    Spans are disjoint and merged where they touch, so each end meets one span at most.
    """
    a = synthetic.select(F.col("doc_id").alias("_d1"), F.col("s").alias("_s1"), F.col("e").alias("_e1"))
    z = synthetic.select(F.col("doc_id").alias("_d2"), F.col("s").alias("_s2"), F.col("e").alias("_e2"))
    out = edits.join(a, (F.col("doc_id") == F.col("_d1")) & (F.col("_s1") <= F.col("md_start")) & (F.col("md_start") < F.col("_e1")), "left")
    out = out.join(z, (F.col("doc_id") == F.col("_d2")) & (F.col("_s2") < F.col("md_end")) & (F.col("md_end") <= F.col("_e2")), "left")
    start = F.coalesce("_e1", "md_start")
    return out.withColumn("snap_start", start).withColumn("snap_end", F.greatest(F.coalesce("_s2", "md_end"), start)).drop("_d1", "_s1", "_e1", "_d2", "_s2", "_e2")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Sorted spans, those that touch or overlap as one.

    A merged span is told by its last row, which knows how far all before it reach, so spans are sorted once, never hashed,
    and what follows by doc_id finds them in order.
    """
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.select("doc_id", "s", "e", (~F.coalesce(F.col("s") <= reach, F.lit(False))).alias("_new"))
    first = F.last(F.when(F.col("_new"), F.struct("s")), ignorenulls=True).over(upto)["s"]
    told = marked.select("doc_id", first.alias("s"), F.max("e").over(upto).alias("e"), F.lead("_new", 1, True).over(order).alias("_last"))
    return told.filter("_last").drop("_last")


def resolve_points(points: DataFrame, runs: DataFrame, locked: DataFrame) -> DataFrame:
    """points(doc_id, edit_id, pos): the first run that holds the place, ends included, or an error."""
    r = runs.select(F.col("doc_id").alias("_doc"), "block_seq", "run_index", F.col("md_start").alias("_s"), F.col("md_end").alias("_e"), "char_offset")
    met = points.join(r, (F.col("doc_id") == F.col("_doc")) & (F.col("_s") <= F.col("pos")) & (F.col("pos") <= F.col("_e")), "left")
    hit = F.when(F.col("_s").isNotNull(), F.struct("block_seq", "run_index", (F.col("char_offset") + F.col("pos") - F.col("_s")).alias("char_offset")))
    out = met.groupBy("doc_id", "edit_id", "pos").agg(F.min(hit).alias("anchor"))
    held = points.join(locked, (points["doc_id"] == locked["doc_id"]) & (locked["s"] < points["pos"]) & (points["pos"] < locked["e"]), "left_semi").select("doc_id", "edit_id", F.lit(True).alias("_held")).distinct()
    error = F.when(F.col("_held"), "locked").when(F.col("anchor").isNull(), "synthetic")
    return out.join(held, ["doc_id", "edit_id"], "left").withColumn("error", error).drop("_held")


def resolve_boundaries(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points as places between paragraphs: block_seq and edge (before the first block, else after one), null inside a block."""
    doc = Window.partitionBy("doc_id").orderBy("md_start")
    b = blocks.withColumn("_first", F.row_number().over(doc) == 1).withColumn("_next", F.lead("md_start").over(doc))
    b = b.select(F.col("doc_id").alias("_doc"), "block_seq", "md_start", "md_end", "_first", "_next")
    pos = F.col("pos")
    before = F.col("_first") & (pos <= F.col("md_start"))
    after = (pos >= F.col("md_end")) & (F.col("_next").isNull() | (pos <= F.col("_next")))
    met = points.join(b, (F.col("doc_id") == F.col("_doc")) & (before | after), "left")
    # the place before the first block counts before any other, then document order
    hit = F.when(F.col("block_seq").isNotNull(), F.struct((~before).alias("o"), "block_seq", F.when(before, "before").otherwise("after").alias("edge")))
    out = met.groupBy("doc_id", "edit_id", "pos").agg(F.min(hit).alias("_hit"))
    return out.select("doc_id", "edit_id", "pos", F.col("_hit.block_seq").alias("block_seq"), F.col("_hit.edge").alias("edge"))


def whole_deletions(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Deletions that cover a block exactly."""
    return edits.join(blocks.select("doc_id", "md_start", "md_end", "block_seq"), ["doc_id", "md_start", "md_end"])
