"""The JSON-line family: payloads, the session gate, coverage, reconciliation, and applying edits to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import jsonl as J
from leafmark.functions.text import normalize_punctuation, trim_ws


def payload_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line): those between the first fence and the next, or all where there is no fence; no blank ones."""
    trimmed = lines.withColumn("line", trim_ws(F.col("line"))).withColumn("_fence", F.startswith("line", F.lit("```")))
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = trimmed.withColumn("_seen", F.sum(F.col("_fence").cast("int")).over(order)).withColumn("_any", F.max("_fence").over(doc))
    inside = F.when(F.col("_any"), (F.col("_seen") == 1) & ~F.col("_fence")).otherwise(F.lit(True))
    return seen.filter(inside & (F.col("line") != "")).drop("_fence", "_seen", "_any")


def evaluated(lines: DataFrame) -> DataFrame:
    """Adds pairs, edit and reason to lines(..., line)."""
    parsed = lines.withColumn("pairs", J.pairs_of(F.col("line"))).withColumn("edit", J.edit_of_line(F.col("line")))
    return parsed.withColumn("reason", J.reason_of(F.col("edit")))


def session_gate(payload: DataFrame, expected: DataFrame, tag: str) -> DataFrame:
    """One code per document of expected(doc_id, token), empty if the payload(doc_id, line_no, line) may be applied."""
    first = payload.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = expected.join(first, "doc_id", "left").withColumn("meta", J.meta_of(J.pairs_of(F.col("first")), tag))
    code = (
        F.when(F.coalesce("token", F.lit("")) == "", "NO_EXPORT_TOKEN")
        .when(F.col("n").isNull(), "NO_PAYLOAD")
        .when(F.col("meta").isNull(), "META_MISSING")
        .when(F.col("meta.session") != F.col("token"), "TOKEN_MISMATCH")
        .when(F.col("meta.cnt") != F.col("n") - 1, "COUNT_MISMATCH")
        .otherwise("")
    )
    return rows.select("doc_id", code.alias("code"))


def unaddressed(comments: DataFrame, edits: DataFrame) -> DataFrame:
    """comments(doc_id, ordinal, comment_id) that no reply or comment of edits(doc_id, change_type, bookmark_id) targets."""
    target = trim_ws(F.col("bookmark_id"))
    kind = F.lower(trim_ws(F.col("change_type")))
    addressed = edits.filter(kind.isin("reply_to_comment", "add_comment_only") & F.startswith(target, F.lit("AR_COMMENT_"))).select("doc_id", target.alias("comment_id"))
    return comments.withColumn("comment_id", trim_ws(F.col("comment_id"))).filter("comment_id != ''").join(addressed, ["doc_id", "comment_id"], "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected, actual(doc_id, ordinal, anchor): missing and extra anchors in first-seen order, and whether all and as many are there."""
    first = lambda rows: rows.groupBy("doc_id", "anchor").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("n"))
    both = first(expected).join(first(actual).withColumnsRenamed({"ordinal": "a_ordinal", "n": "a_n"}), ["doc_id", "anchor"], "full")
    listed = lambda at, other: F.transform(F.array_sort(F.collect_list(F.when(F.col(other).isNull(), F.struct(F.col(at).alias("o"), "anchor")))), lambda x: x["anchor"])
    out = both.groupBy("doc_id").agg(listed("ordinal", "a_ordinal").alias("missing"), listed("a_ordinal", "ordinal").alias("extra"), F.coalesce(F.sum("n"), F.lit(0)).alias("expected"), F.coalesce(F.sum("a_n"), F.lit(0)).alias("actual"))
    return out.withColumn("complete", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.col("expected") == F.col("actual")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix: a binary search over whole prefixes, so long texts cost a few comparisons."""
    most = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(mid - 1).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, lambda acc, i: F.when(acc["low"] < acc["high"], step(acc, i)).otherwise(acc), lambda acc: acc["low"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def minimal_span(old: Column, new: Column) -> Column:
    """prefix, suffix and the new middle between them, null where old and new agree under plain punctuation."""

    def span(t: Column) -> Column:
        return bound(common_prefix(t["a"], t["b"]), lambda p: bound(F.struct(tail(t["a"], p).alias("a"), tail(t["b"], p).alias("b")), lambda r: bound(common_prefix(r["a"], r["b"]), lambda s: told(t, p, s))))

    tail = lambda s, p: F.reverse(F.substring(s, p + 1, F.length(s)))
    told = lambda t, p, s: F.struct(p.alias("prefix"), s.alias("suffix"), F.substring(t["new"], p + 1, F.length(t["new"]) - p - s).alias("middle"))
    both = F.struct(normalize_punctuation(old).alias("a"), normalize_punctuation(new).alias("b"), new.alias("new"))
    return bound(both, lambda t: F.when(t["a"] != t["b"], span(t)))


def apply_summary(plan: DataFrame, comments_total: int) -> DataFrame:
    """Counts per document; comments without a reply from a fixed number of comments."""
    out = plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Applied").alias("applied"), F.count_if(F.col("status") == "Skipped").alias("skipped"), F.count_if(F.col("why") != "PARSE").alias("parsed"), F.count_distinct(F.when(F.startswith("anchor", F.lit("AR_COMMENT_")), F.col("anchor"))).alias("replied"))
    return out.withColumn("unaddressed", F.greatest(F.lit(0), F.lit(comments_total) - F.col("replied")))


def splice(text: DataFrame, edits: DataFrame, accept: bool = True) -> DataFrame:
    """Texts with all edits accepted, or rejected: doc_id, text.

    text(doc_id, text); edits(doc_id, md_start, md_end, new_text), disjoint. The result is the gaps between edits with new
    or old texts, joined in order; nothing is rewritten from right to left.
    """
    order = Window.partitionBy("doc_id").orderBy("md_start", "md_end")
    rows = edits.join(text, "doc_id", "right")
    before = F.coalesce(F.lag("md_end").over(order), F.lit(0))
    cut = lambda a, z: F.substring(F.col("text"), (a + 1).cast("int"), (z - a).cast("int"))
    own = F.col("new_text") if accept else cut(F.col("md_start"), F.col("md_end"))
    piece = F.when(F.col("md_start").isNull(), F.lit("")).otherwise(F.concat(cut(before, F.col("md_start")), own))
    pieces = rows.select("doc_id", "md_start", "md_end", piece.alias("piece"))
    joined = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("md_start", "md_end", "piece"))), lambda x: x["piece"]), "").alias("head"), F.coalesce(F.max("md_end"), F.lit(0)).alias("last"))
    return joined.join(text, "doc_id").select("doc_id", F.concat("head", F.substring(F.col("text"), (F.col("last") + 1).cast("int"), F.length("text"))).alias("text"))
