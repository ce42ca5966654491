"""Exact deduplication against an immutable snapshot.

A snapshot holds one row per distinct digest, dealt into buckets by the digest, and one static binary-fuse filter per
bucket. An incoming batch is grouped by digest on its own; each group's digest is screened by the filter of its bucket, and
only positives join the snapshot's exact bucket, where the normalised texts themselves are compared. For that the texts of
the positives' representatives are shuffled; where their ids are too many to be broadcast (`shared.BROADCAST_ROWS`), all
texts are, once. Everything else that is shuffled is ids and digests.

Defined results: null text counts as empty, so all empty and null texts are copies of one another; null ids sort last and
stay only if no copy has an id; rows that repeat an id and its text are copies, of which one stays; an empty table gives no
rows; further columns are ignored by `decisions` and carried by `drop_copies`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm import fuse_filter
from leafmark.llm.shared import SPACES, join_side, staged

#: Distinct digests that one filter should hold, and that one task screens at once.
FILTER_KEYS = 1 << 14
FILTER_SCHEMA = "bucket int, seed int, length int, starts int, cells binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


@dataclass(frozen=True)
class Snapshot:
    """digests: bucket, digest, first_id, copies. filters: one row per bucket that holds digests."""

    digests: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest of rows(id, digest)."""
    return rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def build_snapshot(rows: DataFrame, filter_keys: int = FILTER_KEYS) -> Snapshot:
    """The snapshot of rows(id, digest); the number of buckets follows the number of digests."""
    groups = staged(grouped(rows), "snapshot-groups")
    buckets = max(1, -(-groups.count() // filter_keys))
    digests = groups.withColumn("bucket", _bucket(buckets))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["bucket"].iloc[0], *fuse_filter.build(_keys(pdf["digest"])))], columns=["bucket", "seed", "length", "starts", "cells"])

    filters = digests.select("bucket", F.substring("digest", 1, 8).alias("digest")).groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)
    return Snapshot(digests, staged(filters, "snapshot-filters"), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """groups(digest, first_id, copies) with bucket and `maybe`: false means that the snapshot surely lacks the digest."""
    parts = max(1, -(-groups.count() // (snapshot.buckets * FILTER_KEYS)))  # of a large batch, a bucket's share is split further
    dealt = groups.withColumn("bucket", _bucket(snapshot.buckets)).withColumn("part", F.pmod(F.crc32("digest"), F.lit(parts)).cast("int"))

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            f = right.iloc[0]
            maybe = fuse_filter.contains(_keys(left["digest"]), int(f["seed"]), int(f["length"]), int(f["starts"]), f["cells"])
        else:
            maybe = np.zeros(len(left), dtype=bool)
        return left[["digest", "first_id", "copies", "bucket"]].assign(maybe=maybe)

    spread = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cogrouped = dealt.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part"))
    return cogrouped.applyInPandas(group, "digest binary, first_id long, copies long, bucket int, maybe boolean")


def byte_checked(hits: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hits(digest, new_id, old_id, ...) after comparing the normalised texts of both representatives; unequal texts stop the job."""
    ids = join_side(hits.select(F.explode(F.array("new_id", "old_id")).alias("_id"), F.col("digest").alias("_digest")).distinct(), "representatives")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(ids, texts["id"].eqNullSafe(ids["_id"])).select("_digest", normalised(F.col("text")).alias("body"))
    found = found.withColumn("digest", F.unhex(F.sha2("body", 256))).filter("digest = _digest").select("digest", "body")
    same = found.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same"))
    fault = F.raise_error(F.concat(F.lit("two texts share the digest "), F.hex("digest")))
    return hits.join(same, "digest").withColumn("digest", F.when(F.col("same"), F.col("digest")).otherwise(fault.cast("binary"))).drop("same")


def duplicate_groups(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of two or more rows: digest, keep_id, group_size. rows(id, digest, is_new) are those of docs."""
    snapshot = build_snapshot(rows.filter(~F.col("is_new")))
    screened = staged(screen(staged(grouped(rows.filter("is_new")), "batch-groups"), snapshot), "screened")
    old = snapshot.digests.select("bucket", "digest", F.col("first_id").alias("old_id"))
    new = screened.filter("maybe").select("bucket", "digest", F.col("first_id").alias("new_id"), "copies")
    hits = staged(new.join(old, ["bucket", "digest"]), "hits")
    checked = byte_checked(hits, docs, id_col, text_col).select("digest", F.col("new_id").alias("first_id"), "copies")
    both = snapshot.digests.select("digest", "first_id", "copies").unionByName(checked).unionByName(screened.join(hits, "digest", "left_anti").select("digest", "first_id", "copies"))
    merged = both.groupBy("digest").agg(F.min("first_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return staged(merged.filter("group_size > 1"), "duplicates")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest and is_new of every row. The older half of the id range is the snapshot, the rest the incoming batch."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    middle = 0 if low is None else (low + high) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"))
    return staged(rows.withColumn("is_new", F.coalesce(F.col("id") > middle, F.lit(True))), "digests")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept."""
    rows = digest_rows(docs, id_col, text_col)
    groups = duplicate_groups(rows, docs, id_col, text_col)
    per_id = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
    joined = per_id.join(groups, "digest", "left").select(
        "id", "digest", "times", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    copy = F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(1).cast("long"), F.col("times"))).otherwise(F.array(F.lit(1).cast("long"))))
    return joined.withColumn("copy", copy).select("id", "digest", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later copies; the columns stay as they are."""
    rows = staged(decisions(docs, id_col, text_col), "decisions")
    state = rows.groupBy("id", "digest").agg(F.max("kept").alias("keep"), F.count(F.lit(1)).alias("times"))
    gone = join_side(state.filter("not keep or times > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "keep"), "gone")
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    single = marked.join(gone, same, "left_anti")
    again = gone.filter("keep")
    if again.isEmpty():
        return single.select("row.*")
    repeated = marked.join(again, same, "left_semi").dropDuplicates(["id", "digest"])
    return single.unionByName(repeated).select("row.*")
