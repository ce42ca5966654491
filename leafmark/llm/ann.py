"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt to shards of bounded size. For each of `PROJECTIONS` random directions a shard keeps its unit vectors'
projections in sorted order; the arrays lie in one flat file per shard, which tasks map. A query opens a window around its own
projection in every array; virtual rehashing widens the windows with the radius, and each step counts only what has come in.
Vectors that collided in at least the threshold's share of windows are verified with the exact measure on the original
vectors. A query ends in a shard once its k nearest verified lie well within the radius, or enough vectors were verified.

Query blocks meet every shard: the work per pair is bounded, and nothing but k rows per query and shard is shuffled behind it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the query's are no candidates; equal scores rank by id; rows that repeat an id are
candidates each, but not for the query of that id; fewer than k candidates give as many ranks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.llm.shared import new_path, staged
from leafmark.llm.token_files import mapped, write_file

PROJECTIONS = 64
SEED = 7
#: Vectors of a shard on average, and queries of a block.
SHARD = 8192
BLOCK = 512
MOST_TASKS = 10000
#: Radii of virtual rehashing, as distances of unit vectors; the half width of a window is the radius.
RADII = (0.3, 0.6, 0.85, 1.0, 1.1, 1.15, 1.2, 1.3, 1.45, 2.01)
#: A vector at the radius collides in 0.683 of the windows; two standard deviations fewer are asked for.
COLLIDING = 0.6827
DEVIATIONS = 2.0
#: A query ends where its k nearest lie within this share of the radius.
NEAR = 0.96
#: Verified vectors of a shard beyond which a query ends: a share, and so many at least.
VERIFIED = 0.4
VERIFIED_LEAST = 2048


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((dim, PROJECTIONS)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


class Shard:
    """One shard's file: ids, vectors, then the values and the order of every sorted array."""

    def __init__(self, path: str, n: int, dim: int):
        raw = mapped(path, "u1")
        sizes = (8 * n, 8 * n * dim, 4 * n * PROJECTIONS, 4 * n * PROJECTIONS)
        parts = np.split(raw, np.cumsum(sizes)[:-1])
        self.n, self.ids, self.vectors = n, parts[0].view("<i8"), parts[1].view("<f8").reshape(n, dim)
        self.values, self.order = parts[2].view("<f4").reshape(PROJECTIONS, n), parts[3].view("<i4").reshape(PROJECTIONS, n)
        self.units = unit(self.vectors)

    @staticmethod
    def parts(ids: np.ndarray, vectors: np.ndarray) -> Iterator[bytes]:
        places = (unit(vectors).astype(np.float32) @ directions(vectors.shape[1])).T
        order = np.argsort(places, axis=1, kind="stable").astype("<i4")
        yield ids.astype("<i8").tobytes()
        yield vectors.astype("<f8").tobytes()
        yield np.take_along_axis(places, order, axis=1).astype("<f4").tobytes()
        yield order.tobytes()

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, near: float = NEAR, verified: float | None = VERIFIED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query's k nearest verified vectors: query id, vector ids, scores."""
        own = unit(queries)
        places = own.astype(np.float32) @ directions(queries.shape[1])
        bounds = [[(np.searchsorted(self.values[j], places[:, j] - r), np.searchsorted(self.values[j], places[:, j] + r, side="right")) for j in range(PROJECTIONS)] for r in RADII]
        bounds = np.array(bounds)  # radius, projection, low or high, query
        enough = self.n if verified is None else max(verified * self.n, VERIFIED_LEAST) + k
        least = (COLLIDING - DEVIATIONS * np.sqrt(COLLIDING * (1 - COLLIDING) / PROJECTIONS)) * PROJECTIONS
        for q in range(len(ids)):
            counts = np.zeros(self.n, dtype=np.int64)
            known = self.ids == ids[q]  # the query's own row isn't a candidate
            found, scores, seen = [], [], 0
            old = None
            for step, radius in enumerate(RADII):
                now = bounds[step, :, :, q]
                new = [self.order[j, a:z] for j in range(PROJECTIONS) for a, z in (((now[j, 0], now[j, 1]),) if old is None else ((now[j, 0], old[j, 0]), (old[j, 1], now[j, 1]))) if a < z]
                old = now
                if new:
                    counts += np.bincount(np.concatenate(new), minlength=self.n)
                fresh = np.flatnonzero((counts >= (least if radius < 2 else 0)) & ~known)
                if len(fresh):
                    known[fresh] = True
                    found.append(fresh)
                    scores.append((self.units[fresh] * own[q]).sum(axis=1))
                    seen += len(fresh)
                    if seen >= k and (seen >= enough or near and np.partition(np.concatenate(scores), -k)[-k] >= 1 - (near * radius) ** 2 / 2):
                        break
            if not found:
                continue
            at, score = np.concatenate(found), np.concatenate(scores)
            best = np.lexsort((self.ids[at], -score))[:k]
            yield int(ids[q]), self.ids[at[best]], score[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, near: float = NEAR, verified: float | None = VERIFIED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row among all other rows."""
    spark = vectors.sparkSession
    folder = new_path(spark, "ann")
    doubles = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), doubles.alias("vector"), is_query.alias("asks")).filter(F.col("id").isNotNull() & valid(F.col("vector")))
    # the place in the input deals out rows that repeat an id
    rows = rows.withColumns({"dim": F.size("vector"), "hash": F.xxhash64("id", F.monotonically_increasing_id())})
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    per_dim = lambda at, size: F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, max(1, -(-n[at] // size)))]), F.col("dim"))  # noqa: E731  as many rows as vector lengths

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, number = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values("id", kind="stable")
        write_file(f"{folder}/{dim}-{number}", Shard.parts(pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy())))
        return pd.DataFrame({"dim": [dim], "shard": [number], "n": [len(pdf)]})

    dealt = rows.withColumn("shard", F.pmod("hash", per_dim(0, shard)).cast("int"))
    index = staged(dealt.select("dim", "shard", "id", "vector").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, n int"), "ann-shards")
    asking = rows.filter("asks").withColumn("block", F.pmod(F.xxhash64("hash"), per_dim(1, block)).cast("int"))
    blocks = asking.groupBy("dim", "block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("vector")).alias("vectors"))
    # every block against every shard of its length: the contract's query set in blocks
    tasks = sum(-(-n // shard) * -(-q // block) for n, q in sizes.values())
    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), per_dim(0, shard) - 1))).join(index, ["dim", "shard"])
    pairs = pairs.repartition(max(1, min(tasks, MOST_TASKS)), "dim", "shard", "block")  # a pair is seconds of work, whatever its bytes

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, number, n, ids, flat = (b.column(c)[i] for c in ("dim", "shard", "n", "ids", "vectors"))
                own = Shard(f"{folder}/{dim}-{number}", n.as_py(), dim.as_py())
                asked = np.array(ids.values), np.array(flat.values).reshape(-1, dim.as_py())
                out = [(np.full(len(v), q), v, s) for q, v, s in own.search(*asked, k, near, verified)]
                if out:
                    yield pa.record_batch([np.concatenate(x) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)
