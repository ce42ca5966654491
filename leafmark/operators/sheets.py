"""Tables that come as spreadsheet cells: one JSON object per cell to rows, wide to long, lookups, summaries, correlations.

Quantiles are exact and interpolated, as spreadsheets and data frames give them: distinct values are ranked by range
partitions and prefix sums over partitions, and only the values at the wanted ranks are looked at, so no column is gathered.

Defined results: blank and null cells are left out; a cell that isn't a JSON object gives a row of nulls with `_error`; summaries
leave nulls and NaN out; a column without values counts none and has null figures, as has the deviation of one value; a
correlation takes the rows in which both columns have values, and is null where one is constant; empty tables give no records
and counts of none; columns that aren't named stay out.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.staging import settled

QUARTILES = (0.25, 0.5, 0.75)


def records(cells: DataFrame, fields: list[tuple[str, str]], cell: str = "json_line") -> DataFrame:
    """cells(..., json_line) as fields (name, type) beside the other columns, and `_error` where the cell is no such object."""
    # inside an array the reader takes nothing behind the object, which it would pass over at the top
    held = F.from_json(F.concat(F.lit("["), F.trim(cell), F.lit("]")), f"array<struct<{','.join(f'`{n}`:{t}' for n, t in fields)}>>")
    one = F.when(F.size(held) == 1, F.get(held, F.lit(0)))
    rows = cells.filter(F.trim(cell) != "").withColumn("_r", one)
    names = [n for n, _ in fields]
    others = [c for c in cells.columns if c != cell and c not in names]
    return rows.select(*others, *[F.col("_r").getField(n).alias(n) for n in names], F.col("_r").isNull().alias("_error"))


def melt(wide: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per row and value column."""
    return wide.unpivot(ids, values, variable, value)


def looked_up(rows: DataFrame, table: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """rows with columns of table's row of the same key, null where there is none; of repeated keys the smallest row counts."""
    one = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*wanted)).alias("_v"))
    return rows.drop(*wanted).join(one, key, "left").select(*[F.col(c) for c in rows.columns if c not in wanted], *[F.col("_v").getField(c).alias(c) for c in wanted])


def _sound(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(values: DataFrame, shares: tuple[float, ...] = QUARTILES) -> DataFrame:
    """values(variable, value) as variable, share, value: interpolated between the neighbours of the rank share * (n - 1)."""
    counted = values.filter("value is not null").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = settled(counted.repartitionByRange("variable", "value").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("variable", "part").agg(F.sum("n").alias("_n"))  # a row per variable and partition
    before = Window.partitionBy("variable").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("variable", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("variable", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(bases, ["variable", "part"]).withColumn("_end", F.col("_base") + F.sum("n").over(inside))
    at = F.col("share") * (F.col("_total") - 1)
    wanted = parts.groupBy("variable").agg(F.sum("_n").alias("_total")).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    wanted = wanted.withColumn("_low", F.floor(at)).withColumn("_weight", at - F.floor(at))
    holds = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("n"))
    low, high = F.col("_low"), F.least(F.col("_low") + 1, F.col("_total") - 1)
    met = placed.join(wanted, "variable").filter(holds(low) | holds(high))
    both = met.groupBy("variable", "share", "_weight").agg(F.max(F.when(holds(low), F.col("value"))).alias("_a"), F.max(F.when(holds(high), F.col("value"))).alias("_b"))
    return both.select("variable", "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_weight")).alias("value"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: variable, count, mean, std, min, p25, p50, p75, max."""
    long = settled(melt(rows.select(*[_sound(c).alias(c) for c in columns]), [], columns))
    named = rows.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    told = long.groupBy("variable").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    cut = quantiles(long).groupBy("variable").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{int(s * 100)}") for s in QUARTILES])
    out = named.join(told, "variable", "left").join(cut, "variable", "left")
    return out.select("variable", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r for each pair of columns, in one pass over the rows."""
    pairs = list(combinations_with_replacement(columns, 2))
    both = lambda c, other: F.when(_sound(other).isNotNull(), _sound(c))
    spread = lambda x, y: F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x))
    aggregated = rows.agg(*[(F.covar_pop(both(x, y), both(y, x)) / F.nullif(spread(x, y), F.lit(0.0))).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    told = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs) for a, b in dict.fromkeys(((x, y), (y, x)))]
    return aggregated.select(F.explode(F.array(*told)).alias("p")).select("p.*")
