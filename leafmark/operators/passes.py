"""Reviewer passes: observations of one author, split where more than a gap passes between dated ones.

Observations: doc_id, doc_order, kind, author, date (timestamp or null); an empty author is `Unknown`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import plural
from leafmark.operators.threads import ancestry

GAP_HOURS = 48
KINDS = {"insertions": "insertion", "deletions": "deletion", "comments": "comment", "replies": "comment-reply"}


def named(observations: DataFrame) -> DataFrame:
    return observations.withColumn("author", F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")))


def assign_passes(observations: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Adds `pass_no` (from 0) within document and author.

    Dated observations are sessionized by their gaps in milliseconds. Undated ones join the only dated pass, or form a pass
    of their own behind several dated ones, or the single pass of an author without dates.
    """
    rows = named(observations).withColumn("_ms", F.unix_millis(F.col("date").cast("timestamp")))
    by_time = Window.partitionBy("doc_id", "author").orderBy("_ms", "doc_order")
    dated = rows.filter("_ms is not null")
    gap = F.col("_ms") - F.lag("_ms").over(by_time)
    dated = dated.withColumn("_new", F.when(gap > int(gap_hours * 3600 * 1000), 1).otherwise(0))
    dated = dated.withColumn("pass_no", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    last = dated.groupBy("doc_id", "author").agg(F.max("pass_no").alias("_last"))
    undated = rows.filter("_ms is null").join(last, ["doc_id", "author"], "left")
    undated = undated.withColumn("pass_no", F.when(F.coalesce("_last", F.lit(0)) == 0, F.lit(0)).otherwise(F.col("_last") + 1).cast("long"))
    return dated.drop("_new", "_ms").unionByName(undated.drop("_last", "_ms"))


def pass_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == kind).alias(name) for name, kind in KINDS.items()]


def stripped_metadata(observations: DataFrame) -> DataFrame:
    """doc_id, metadata_stripped: one author and no date at all."""
    one = F.count_distinct("author") == 1
    return named(observations).groupBy("doc_id").agg((one & (F.count("date") == 0)).alias("metadata_stripped"))


def passes(observations: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """One row per pass: window, counts and label."""
    rows = assign_passes(observations, gap_hours)
    out = rows.groupBy("doc_id", "author", "pass_no").agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"), *pass_counts())
    out = out.join(stripped_metadata(observations), "doc_id")
    return out.withColumn("undated", F.col("window_start").isNull()).withColumn("pass_date", F.date_format("window_start", "yyyy-MM-dd")).withColumn("label", label())


def label() -> Column:
    edits = F.col("insertions") + F.col("deletions")
    tail = F.concat(F.lit(" ("), plural(edits, "edit"), F.lit(", "), plural(F.col("comments"), "comment"), F.lit(", "), F.col("replies").cast("string"), F.when(F.col("replies") == 1, " reply)").otherwise(" replies)"))
    return F.when(F.col("metadata_stripped"), F.concat("author", F.lit(" (metadata stripped)"))).otherwise(F.concat("author", F.lit(" — "), F.coalesce("pass_date", F.lit("undated")), tail))


def members(observations: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Each pass with its observations in document order."""
    return assign_passes(observations, gap_hours).groupBy("doc_id", "author", "pass_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_order", "kind"))), lambda m: m["doc_order"]).alias("members"))


def merge_aliases(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replaces authors by their canonical names, aliases(alias, canonical), followed to their ends beforehand."""
    return observations.join(aliases.withColumnRenamed("alias", "author"), "author", "left").withColumn("author", F.coalesce("canonical", "author")).drop("canonical")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """aliases(alias, canonical) with each canonical name that is an alias itself replaced by its own, to the end; of names
    in a cycle, by the least."""
    found = ancestry(aliases.select(F.col("alias").alias("comment_id"), F.col("canonical").alias("parent_id")))
    cycle = F.slice("path", F.lit(1), F.array_position("path", F.col("up")).cast("int"))
    end = F.when(F.array_contains("path", F.col("up")), F.array_min(cycle)).otherwise(F.col("up"))
    return found.groupBy(F.col("comment_id").alias("alias")).agg(F.max_by(end, F.size("path")).alias("canonical"))


def author_tally(observations: DataFrame) -> DataFrame:
    return named(observations).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def author_kind_pivot(observations: DataFrame) -> DataFrame:
    return named(observations).groupBy("author").pivot("kind", list(KINDS.values())).agg(F.count(F.lit(1))).na.fill(0)


def baseline(observations: DataFrame, target: str) -> DataFrame:
    """Per document, what others did before the target author's first dated observation: what a baseline accepts."""
    rows = named(observations)
    own = F.lower("author") == target.lower()
    first = rows.filter(own).groupBy("doc_id").agg(F.min("date").alias("first_date"))
    return rows.filter(~own & F.col("kind").isin("insertion", "deletion")).join(first, "doc_id").filter("date < first_date")


def corpus_records(observations: DataFrame, target: str, context: int = 500) -> DataFrame:
    """The target author's observations as JSON lines, contexts clipped, with positional anchors."""
    own = named(observations).filter(F.lower("author") == target.lower())
    clipped = own.withColumn("context", F.substring("text", 1, context))
    anchor = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_order"))
    record = F.struct("doc_id", F.col("author").alias("target_author"), F.when(F.col("kind").isin("insertion", "deletion"), "revision").otherwise("comment").alias("record_type"), "kind", "context", F.format_string("AR_REV_%05d", anchor).alias("anchor"))
    return clipped.select("doc_id", "doc_order", F.to_json(record).alias("line"))


def next_unreviewed(decisions: DataFrame) -> DataFrame:
    """Per document the lowest edit not yet reviewed (null if none), and whether all are: true of no edits."""
    todo = ~F.coalesce("reviewed", F.lit(False))
    return decisions.groupBy("doc_id").agg(F.min(F.when(todo, F.col("edit_id"))).alias("next_edit"), F.coalesce(F.bool_and(~todo), F.lit(True)).alias("all_reviewed"))


def attempts_by_gate(attempts: DataFrame) -> DataFrame:
    """attempts(doc_id, attempt_no, gate): the number per gate, and the length of the run that ends at each attempt."""
    order = Window.partitionBy("doc_id").orderBy("attempt_no")
    change = F.when(F.col("gate").eqNullSafe(F.lag("gate").over(order)), 0).otherwise(1)
    islands = attempts.withColumn("_change", change).withColumn("_island", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("doc_id", "_island").orderBy("attempt_no"))
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "gate"))
    return islands.select("doc_id", "attempt_no", "gate", run.cast("long").alias("consecutive"), total.alias("of_gate"))
