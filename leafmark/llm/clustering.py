"""Centroid clustering in exact integers, with block-norm screening.

Vectors become integers floor(scale * x) once. Around a fixed centre each is stored compressed too: its components in eight bits
of a step of its own, the norms of its segments' remainders, and its square. With w = code + rest and a centroid d, the squared
distance is |w|**2 + |d|**2 - 2 code.d - 2 rest.d, and by Cauchy-Schwarz rest.d is at most the sum over segments of |rest_s||d_s|:
compressed vectors and centroids give every pair a lower bound by one matrix product. The centroid of least bound gets the exact
distance first, and then only centroids whose bound doesn't exceed it. Bounds are floats and lowered by their rounding error;
distances are integers. A round is one pass over the stored table: every task returns a count and sums per cluster, which Spark
adds up; the driver holds k centroids, nothing else.

Defined results: vectors that are null, of another length, or that hold null or non-finite components take no part, nor do
vectors with a component beyond 2**27 after scaling, whose distances a long can't hold; fewer than k vectors are that many
centroids; a repeated id is ordered by its components where it becomes a first centroid, a null id comes last there; equal
vectors may give equal centroids, of which the smaller number wins; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import staged

DIMENSIONS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, "2", 256
SEGMENT, CODE = 8, 127
LARGEST = 1 << 27
#: Vectors that meet the centroids at once, and pairs whose exact distances are taken at once.
SLICE, PAIRS = 4096, 1 << 15


def whole(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The integer vector, null where the vector takes no part."""
    real = F.transform(embedding, lambda x: x.cast("double"))
    sound = (F.size(embedding) == dimensions) & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(real, lambda x: F.floor(x * scale))
    near = F.forall(real, lambda x: F.abs(x * scale) <= LARGEST)
    return F.when(sound & near, F.transform(scaled, lambda x: x.cast("int")))


def matrix(column: pa.Array, dimensions: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions).astype(kind)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the vectors' segments."""
    short = -vectors.shape[1] % SEGMENT
    blocks = np.pad(vectors, ((0, 0), (0, short))).reshape(len(vectors), -1, SEGMENT)
    return np.sqrt((blocks * blocks).sum(axis=2).astype(np.float64))


@dataclass(frozen=True)
class Compressed:
    """Codes (eight bits a component), steps, squares of whole vectors and norms of the segments of what the codes leave."""

    codes: np.ndarray
    steps: np.ndarray
    squares: np.ndarray
    rests: np.ndarray


def compressed(moved: np.ndarray) -> Compressed:
    """The compressed form of vectors around the centre; a step is the power of two that brings a vector into its codes."""
    highest = np.abs(moved).max(axis=1, initial=0)
    steps = np.int64(1) << np.maximum(0, np.ceil(np.log2(np.maximum(highest, 1) / CODE))).astype(np.int64)
    codes = np.rint(moved / steps[:, None]).astype(np.int64)
    return Compressed(codes.astype(np.int8), steps, (moved * moved).sum(axis=1), norms(moved - codes * steps[:, None]))


def distances(vectors: np.ndarray, centroids: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), dtype=np.int64)
    for a in range(0, len(row), PAIRS):
        gap = vectors[row[a : a + PAIRS]] - centroids[column[a : a + PAIRS]]
        out[a : a + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def bounds(held: Compressed, moved: np.ndarray) -> np.ndarray:
    """A lower bound of every squared distance to centroids around the centre, lowered by more than its rounding error."""
    near = (held.codes * held.steps[:, None].astype(np.float64)) @ moved.T.astype(np.float64)
    size = held.squares[:, None] + (moved * moved).sum(axis=1)[None, :].astype(np.float64)
    return size - 2 * (near + held.rests @ norms(moved).T) - size * 1e-11 - 1


def nearest(vectors: np.ndarray, held: Compressed, centroids: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many pairs were measured."""
    least = bounds(held, centroids - centre)
    every = np.arange(len(vectors))
    first = least.argmin(axis=1)
    reached = distances(vectors, centroids, every, first)
    open_pairs = least <= reached[:, None]
    open_pairs[every, first] = False
    row, column = np.nonzero(open_pairs)
    rows, columns = np.concatenate([every, row]), np.concatenate([first, column])
    found = np.concatenate([reached, distances(vectors, centroids, row, column)])
    order = np.lexsort((columns, found, rows))
    _, begin = np.unique(rows[order], return_index=True)
    chosen = order[begin]
    return columns[chosen], found[chosen], len(rows)


@dataclass(frozen=True)
class Centroids:
    """The centroids, and the fixed centre around which vectors are compressed."""

    values: np.ndarray
    centre: np.ndarray

    def assign(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        dimensions, segments = self.values.shape[1], -(-self.values.shape[1] // SEGMENT)
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            vectors = matrix(part.column("whole"), dimensions, np.int64)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.int8).reshape(-1, dimensions)
            held = Compressed(codes, part.column("step").to_numpy(), part.column("square").to_numpy(), matrix(part.column("rests"), segments, np.float64))
            cluster, distance, _ = nearest(vectors, held, self.values, self.centre)
            yield part, vectors, cluster, distance


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id: k rows to the driver."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(told.alias("told"), "whole").orderBy(F.col("told").asc_nulls_last(), "whole").limit(k).collect()
    return np.array([r["whole"] for r in rows], dtype=np.int64)


def with_codes(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    """vectors(id, whole) beside their compressed form."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                held = compressed(matrix(part.column("whole"), len(centre), np.int64) - centre)
                rests = pa.ListArray.from_arrays(np.arange(0, held.rests.size + 1, held.rests.shape[1], dtype=np.int32), pa.array(held.rests.ravel()))
                columns = [pa.array([c.tobytes() for c in held.codes], pa.binary()), pa.array(held.steps), pa.array(held.squares), rests]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "codes", "step", "square", "rests"])

    return vectors.mapInArrow(add, "id long, whole array<int>, codes binary, step long, square long, rests array<double>")


def moved(vectors: DataFrame, now: Centroids) -> np.ndarray:
    """The centroids after one round: the floor of each non-empty cluster's mean."""
    k, dimensions = now.values.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, values, cluster, _ in now.assign(batch):
                counts += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, values)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": held.astype(np.int32), "count": counts[held], "sums": list(sums[held])}, pa.schema([("cluster", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = vectors.mapInArrow(add_up, "cluster int, count long, sums array<long>")
    rows = parts.select("cluster", "count", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("count").alias("count"), F.sum("part").alias("sum"))
    out = now.values.copy()
    for r in rows.collect():  # k * dimensions rows
        out[r["cluster"], r["at"]] = r["sum"] // r["count"]
    return out


def clusters(rows: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (its components) of every vector that takes part."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), whole(F.col(embedding_col), dimensions, scale).alias("whole")).filter("whole is not null")
    values = first_centroids(vectors, k, seed).reshape(-1, dimensions)
    if not len(values):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centre = values.sum(axis=0) // len(values)
    held = staged(with_codes(vectors, centre), "cluster-vectors")
    for _ in range(rounds):
        values = moved(held, Centroids(values, centre))
    last = Centroids(values, centre)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, cluster, distance in last.assign(batch):
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "cluster": cluster.astype(np.int32), "distance": distance})

    labelled = staged(held.mapInArrow(label, "id long, cluster int, distance long"), "cluster-labels")
    sums = dict(labelled.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    told = [(c, sums[c], sum(sums.values()), [int(x) for x in values[c]]) for c in sorted(sums)]
    known = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    return labelled.join(known, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(components: list[int]) -> str:
    return sha256(",".join(map(str, components)).encode()).hexdigest()
