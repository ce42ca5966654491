"""Line deduplication, in DataFrame expressions only.

Normalised lines are exploded and hashed (128 bits of SHA-256), the distinct documents of each hash are counted, lines over
the threshold go, except in the document with the smallest id, and the others are put together again by position. Only hashes,
ids and positions are exploded and grouped; a text is shuffled once, whole, to meet the positions that it loses. Counting is by
(hash, id) first, so a line that a third of all documents share is one row per task when it reaches its hash; occurrences
meet the written table of shared lines by a plain equality, whose skewed partitions adaptive execution splits.

Defined results: null and empty texts are one empty line; keys shorter than `min_chars` code points are never dropped; a
document is an id, so rows that repeat an id count once and lose the same lines, and rows without an id are one document,
which comes after all others; rows with nothing to drop keep their text as it is, null too; an empty table gives no rows;
further columns stay, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import staged

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 10, 2
NEW = ("n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def hash_of(line: Column, min_chars: int) -> Column:
    """16 bytes of the key's SHA-256, null where the key is too short to be dropped."""
    hashed = lambda key: F.when(F.length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))
    return F.transform(F.array(key_of(line)), hashed)[0]


def occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows(id, part, text) as id, part, at (position of the line, from 0), hash."""
    hashes = F.transform(lines_of(F.col("text")), lambda line: hash_of(line, min_chars))
    return rows.select("id", "part", F.posexplode(hashes).alias("at", "hash")).filter("hash is not null")


def dropped(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The positions that rows(id, part, text) lose: id, part, drops (distinct positions, in any order)."""
    all_lines = occurrences(rows, min_chars)
    counted = all_lines.groupBy("hash").agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("long"))).alias("docs"), F.min("id").alias("first"))
    # written first: behind an aggregation the join's side wouldn't be a plain exchange, and a hot line's partition not split
    shared = staged(counted.filter(F.col("docs") >= min_docs).select("hash", "first"), "shared-lines")
    gone = all_lines.join(shared, "hash").filter(~F.col("id").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "part").agg(F.collect_set("at").alias("drops"))


def without(text: Column, drops: Column) -> Column:
    """The text without the lines at the given positions; linear in the lines."""
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops), lambda i: F.get(lines, i))
    return F.array_join(F.transform(F.array(lines_of(text)), kept)[0], "\n")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text that stays, n_lines (before dropping) and n_dropped."""
    if min_docs < 2:
        raise ValueError("a line that one document holds is not shared: min_docs must be 2 or more")
    # `part` tells the texts of one id apart, so that what is collected per row never exceeds its text's lines
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text"))
    gone = dropped(rows.select("id", "part", "text"), min_chars, min_docs).select(F.col("id").alias("_id"), F.col("part").alias("_part"), "drops")
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left")
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("drops")))
    kept = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in NEW]
    return met.select(*kept, F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
