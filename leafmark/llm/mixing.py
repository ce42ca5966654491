"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight; a source whose share exceeds `max_epochs` times its own words is
clamped there and its excess goes to the others by weight, until none is above. A source then repeats each document
floor(rate) times, and the first documents in a seeded order once more, up to the fraction that is left: the taken words
miss the target by half a document at most.

Only per-source and per-(source, slice) sums are windowed. Documents are ordered within one of 4096 slices of the seeded
order, the one in which the fraction ends; `water_fill` orders the sources, one row each, in one task.

Defined results: null text has size 0; documents of size 0 are taken floor(rate) times or once more but add no words; a
null source is a source, last in order; repeated rows count and are taken like any others; rows without an id are placed by
their text; an empty table gives no rows; a source
without words has target 0; further columns are carried by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.llm.shared import WORD, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Copies of the small per-source table, so that a hot source joins in many tasks.
SALTS = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """60 bits of md5: the seeded order of documents, the same in any SQL engine."""
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size) with `target`. One row per source, so single-task windows are small here.

    With sources sorted by cap over weight, those clamped are a prefix. Clamping a source that is above its cap raises the
    level of the others, clamping any other lowers it: the level sought is the highest of all prefixes.
    """
    cap = F.col("source_size") * max_epochs
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1).cast("long")).withColumn("cap", cap)
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level.cast("double"))
    share = F.max("level").over(everything) * F.col("weight")
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), share)).select("source", "source_size", "target")


def _keys(id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    place = seeded(F.col(id_col), F.col(text_col), seed)
    return [F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), place.alias("place"), F.shiftright(place, 48).cast("int").alias("slice")]


def _sources(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source and salt: target, whole repetitions, and the slice in which the fraction ends with the words before it."""
    slices = staged(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    sources = water_fill(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = staged(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    sums = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    filled = slices.withColumn("before", F.coalesce(F.sum("words").over(sums), F.lit(0).cast("long")))
    of = filled.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    edge = of.filter("before < rest").groupBy("source").agg(F.max_by("before", "slice").alias("before"), F.max("slice").alias("edge"))
    known = sources.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return staged(known.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "salted")


def _timed(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with what is known of their sources: those whose `times` is sure, and those of the slice in which a fraction ends."""
    per_row = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")) & (F.pmod("place", F.lit(SALTS)).cast("int") == F.col("_salt")))
    at_edge = F.coalesce(F.col("slice") == F.col("edge"), F.lit(False))
    extra = F.coalesce(F.col("slice") < F.col("edge"), F.lit(False)).cast("int")
    return per_row.filter(~at_edge).withColumn("times", (F.col("whole") + extra).cast("int")), per_row.filter(at_edge)


def _last(rows: DataFrame) -> DataFrame:
    """Rows of the slices in which fractions end, with times: in order until the fraction is met."""
    running = Window.partitionBy("source").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("size") / 2 <= F.col("rest")
    return rows.withColumn("times", (F.col("whole") + extra.cast("int")).cast("int"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, times (repetitions)."""
    rows = staged(docs.select(*_keys(id_col, text_col, source_col, seed)), "sizes")
    sure, edge = _timed(rows, _sources(rows, weights, max_epochs))
    return sure.unionByName(_last(edge)).select("id", "size", "source", "source_size", "target", "times")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row as often as `plan` takes it; the columns stay as they are.

    Whole rows meet only the table of sources; those of the slices in which fractions end meet their own numbers.
    """
    keys = _keys(id_col, text_col, source_col, seed)
    rows = staged(docs.select(*keys), "sizes")
    sources = _sources(rows, weights, max_epochs)
    group = ["id", "source", "size", "place"]
    counted = _last(_timed(rows, sources)[1]).groupBy(*group).agg(F.min("times").alias("_low"), F.sum("times").alias("_total"), F.count(F.lit(1)).alias("_n"))
    counted = staged(counted.select(*[F.col(c).alias(f"_{c}") for c in group if c != "source"], F.col("source").alias("_of"), "_low", (F.col("_total") - F.col("_low") * F.col("_n")).alias("_more")), "edge-times")
    sure, edge = _timed(docs.select(F.struct(*docs.columns).alias("row"), *keys), sources)
    edge = edge.join(counted, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_size")) & (F.col("place") == F.col("_place")))
    taken = lambda df, n: df.withColumn("_i", F.explode(F.sequence(F.lit(1), n))).select("row.*")
    out = taken(sure.filter("times > 0"), F.col("times")).unionByName(taken(edge.filter("_more = 0 and _low > 0"), F.col("_low")))
    if counted.filter("_more > 0").isEmpty():
        return out
    # of rows that agree in all keys, the first so many once more: equal rows are counted, different ones ordered by hash
    alike = edge.filter("_more > 0").groupBy("row", *group, "_low", "_more").agg(F.count(F.lit(1)).alias("_copies"))
    before = Window.partitionBy(*group).orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col("_more") - F.coalesce(F.sum("_copies").over(before), F.lit(0)), F.lit(0))
    n = (F.col("_low") * F.col("_copies") + F.least(left, F.col("_copies"))).cast("int")
    return out.unionByName(taken(alike.withColumn("_times", n).filter("_times > 0"), F.col("_times")))
