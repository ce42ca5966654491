"""Comment threads: a forest by parent id, expanded depth first and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions.text import format_date
from leafmark.staging import SMALL_ROWS, settled


def ancestry(rows: DataFrame, *within: str) -> DataFrame:
    """rows(*within, comment_id, parent_id) as *within, comment_id, path and up.

    path runs from the highest ancestor down to the comment. up is what stands above it: null above a root, else a parent
    that has no row or, in a cycle, the one that the path would repeat. Each round puts the path of what stands above
    before the path so far, so rounds grow with the logarithm of the depth, whatever it is.
    """
    path, up, ended = F.col("path"), F.col("up"), F.col("up").isNull() | F.coalesce(F.array_contains("path", F.col("up")), F.lit(False))
    kind = rows.schema["comment_id"].dataType
    first = rows.select(*within, "comment_id", F.array("comment_id").alias("path"), F.col("parent_id").cast(kind).alias("up"))
    first = settled(first.withColumn("ended", ended))
    done, rest = first.filter("ended"), first.filter("NOT ended")
    while not rest.isEmpty():
        above = done.unionByName(rest).select(*within, F.col("comment_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"), F.col("ended").alias("_ended"))
        longer = rest.drop("ended").join(above, [*within, "up"], "left").withColumn("path", F.when(F.col("_path").isNull(), path).otherwise(F.concat("_path", path)))
        # a walk that has come round repeats only what it has met, so its distinct part is the end of the path
        excess = F.size("path") - F.size(F.array_distinct("path"))
        cut = F.slice("path", F.col("_excess") + 1, F.size("path") - F.col("_excess"))
        over = F.when(F.col("_path").isNull(), up).when(F.col("_excess") > 0, F.get("path", F.col("_excess") - 1)).otherwise(F.col("_up"))
        longer = longer.withColumn("_excess", excess).withColumns({"path": cut, "up": over})
        longer = settled(longer.select(*within, "comment_id", "path", "up", (F.coalesce("_ended", F.lit(True)) | ended).alias("ended")))
        done, rest = done.unionByName(longer.filter("ended")), longer.filter("NOT ended")
    return (done if done.count() <= SMALL_ROWS else done.hint("merge")).drop("ended")  # a union hides what `settled` says of its tables


def expand(comments: DataFrame, every: bool = False) -> DataFrame:
    """comments(doc_id, comment_id, parent_id, ...) with root_id, depth and path; paths sort depth first.

    every: not only threads but the subtree of each comment, as if it were a root; a cycle ends where it would repeat.
    """
    found = ancestry(comments, "doc_id")
    if every:
        found = found.withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("path")))).withColumn("path", F.slice("path", F.col("_from"), F.size("path")))
    else:
        found = found.filter("up IS NULL")
    return found.select("doc_id", "comment_id", F.get("path", F.lit(0)).alias("root_id"), (F.size("path") - 1).alias("depth"), "path")


def token(author: Column, date: Column, done: Column, text: Column, depth: Column) -> Column:
    """One comment as markup: arrows by depth, day, resolved mark."""
    arrow = F.when(depth > 0, F.concat(F.repeat(F.lit("↳"), depth), F.lit(" "))).otherwise("")
    day = F.when(F.coalesce(F.length(date), F.lit(0)) > 0, F.concat(F.lit(" ("), format_date(date), F.lit(")"))).otherwise("")
    return F.concat(F.lit("{>>"), arrow, author, day, F.when(done, " [resolved]").otherwise(""), F.lit(": "), text, F.lit("<<}"))


def render(comments: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, root_id and the thread's markup, replies depth first."""
    rows = expand(comments, every=every).join(comments.select("doc_id", "comment_id", "author", "date", "done", "text"), ["doc_id", "comment_id"])
    told = token(F.col("author"), F.col("date"), F.col("done"), F.col("text"), F.col("depth"))
    ordered = F.array_sort(F.collect_list(F.struct("path", told.alias("token"))))
    return rows.groupBy("doc_id", "root_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("thread"))


def totals(comments: DataFrame) -> DataFrame:
    """Per document: all comments, those not resolved, and threads."""
    return comments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("done", F.lit(False))).alias("unresolved"), F.count_if(F.col("parent_id").isNull()).alias("threads"))


def resolve_extended(comments: DataFrame, paragraphs: DataFrame, extended: DataFrame) -> DataFrame:
    """Resolution and parents from the extended part.

    comments(doc_id, comment_id, ...), paragraphs(doc_id, para_id, comment_id): every paragraph of a comment's body;
    extended(doc_id, para_id, parent_para_id, done). Documents without the extended part keep null: no data.
    """
    para = paragraphs.select("doc_id", "para_id", "comment_id")
    own = extended.join(para, ["doc_id", "para_id"])
    parent = para.select("doc_id", F.col("para_id").alias("parent_para_id"), F.col("comment_id").alias("parent_id"))
    known = own.join(parent, ["doc_id", "parent_para_id"], "left").groupBy("doc_id", "comment_id").agg(F.max("done").alias("_done"), F.max("parent_id").alias("_parent"))
    has = extended.select("doc_id").distinct().withColumn("_has", F.lit(True))
    joined = comments.drop("done", "parent_id").join(known, ["doc_id", "comment_id"], "left").join(has, "doc_id", "left")
    return joined.withColumn("done", F.when(F.col("_has"), F.coalesce("_done", F.lit(False)))).withColumn("parent_id", F.col("_parent")).drop("_done", "_parent", "_has")
