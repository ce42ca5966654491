"""SimHash near-duplicates: 64-bit fingerprints that differ in at most four bits are linked; components are the groups.

Three segments of 22, 21 and 21 bits: of four differing bits, one segment holds at most one. Each distinct fingerprint is
indexed under every one-wildcard variant of every segment (64 keys, each the segment without one bit), so that two linked
fingerprints share a key; the fingerprints under a key are compared in full. Under a key only a spanning forest of the
links is emitted, never all pairs of a dense group: components stay the same. Keys with over `HOT_RUN` fingerprints leave
the streaming pass and are joined by Spark, which splits them.

Defined results: null text counts as empty; texts without words have the fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; null ids take part, but a component's id is its smallest non-null id;
repeated rows are members like any others; an empty table gives no rows; further columns are ignored by `groups` and
carried by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.components import components
from leafmark.llm.shared import join_side, staged

WORDS = 4
BITS = 4
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HOT_RUN = 1 << 16
#: Runs over this length are linked by search rather than by all offsets.
SHORT_RUN = 48


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles of a UTF-8 text, A-Z in lower case."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:z], SEED) for a, z in zip(starts, ends[-n:].tolist())])
    ones = np.zeros(64, dtype=np.int64)
    table = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(table[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t or b"", words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: segment, wildcard bit and the segment's other bits, in an int."""
    keys = []
    for s, (first, width) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        keys += [F.lit((s << 27) | (bit << 22)).bitwiseOR(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).cast("int")) for bit in range(width)]
    return F.array(*keys)


def _links_of_run(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one key: each reached one scans those not yet reached."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                todo.extend(found)
    return left, right


def _runs(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    left, right = [], []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    lengths = ends - starts
    for a, z in zip(starts[lengths > SHORT_RUN], ends[lengths > SHORT_RUN]):
        x, y = _links_of_run(fps[a:z], bits)
        left, right = left + x, right + y
    short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    keys, fps = keys[short], fps[short]
    for step in range(1, SHORT_RUN):
        same = keys[step:] == keys[:-step] if len(keys) > step else np.zeros(0, dtype=bool)
        if not same.any():
            break
        x, y = fps[:-step][same], fps[step:][same]
        near = np.bitwise_count(x ^ y) <= bits
        left.append(x[near])
        right.append(y[near])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link_runs(batches: Iterator[pa.RecordBatch], bits: int = BITS, hot_run: int = HOT_RUN) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp) in key order as links (u, v); the members of an overlong run come out as (key, u) instead."""

    def out(u: np.ndarray, v: np.ndarray | None, key: int | None) -> pa.RecordBatch:
        n = len(u)
        columns = [pa.array(u.view(np.int64)), pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64)), pa.nulls(n, pa.int32()) if key is None else pa.array(np.full(n, key, dtype=np.int32))]
        return pa.record_batch(columns, names=["u", "v", "key"])

    keys, fps = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)
    hot = None
    for b in batches:
        keys = np.concatenate((keys, b.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if hot is not None:
            n = int(np.searchsorted(keys, hot, side="right"))
            if n:
                yield out(fps[:n], None, hot)
            keys, fps, hot = keys[n:], fps[n:], hot if n == len(keys) else None
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if cut:
            yield out(*_runs(keys[:cut], fps[:cut], bits), None)
            keys, fps = keys[cut:], fps[cut:]
        if len(keys) > hot_run:
            hot = int(keys[0])
            yield out(fps, None, hot)
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield out(*_runs(keys, fps, bits), None)


def links(prints: DataFrame, bits: int = BITS, hot_run: int = HOT_RUN) -> DataFrame:
    """Links u, v that span the components of prints(fp), distinct fingerprints."""
    keyed = prints.select(F.explode(variants(F.col("fp"))).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = staged(keyed.mapInArrow(lambda batches: link_runs(batches, bits, hot_run), "u long, v long, key int"), "links")
    hot = found.filter("key is not null").select("key", "u")
    plain = found.filter("key is null").select("u", "v").distinct()
    if hot.isEmpty():
        return plain
    pairs = hot.join(hot.withColumnRenamed("u", "v"), "key").filter("u < v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return plain.unionByName(pairs.select("u", "v")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, hot_run: int = HOT_RUN) -> DataFrame:
    """One row per row of docs: id, fp, component_id."""
    if not 0 <= bits <= BITS:
        raise ValueError("three segments find differences of up to four bits")
    rows = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("members")), "classes")
    roots = staged(components(links(classes.select("fp"), bits, hot_run)), "roots")
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").filter("members > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = staged(linked.join(lowest, "root").select("fp", "component_id", F.lit(True).alias("grouped")), "grouped")
    joined = rows.join(known, "fp", "left")
    return joined.select("id", "fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """docs with only the smallest id of each component; the columns stay as they are.

    Ids must tell the rows apart, as they do behind exact dedup; rows that repeat an id stay or go together.
    """
    gone = groups(docs, id_col, text_col, **how).filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(join_side(gone, "near-copies"), F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("row.*")
