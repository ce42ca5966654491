"""A Merkle manifest of a dataset: one tree per group of rows, one over the groups' roots, and a proof per row.

Leaves are ranked inside their group by range partitions and prefix sums over partitions. Blocks of 8**levels neighbours are
then reduced by a task each, which leaves a small top tree. The driver builds that and broadcasts the paths from the blocks
to the root; tasks read the blocks again, complete each row's proof and fold it. While more than `top_nodes` nodes are left,
they are reduced by tasks once more, and where the groups themselves are too many, their roots are ranked and reduced like
leaves; paths then come down the same way, block by block. So what the driver and a broadcast hold is bounded by
`top_nodes` at any size of the table, and a task holds one block.

Digests are SHA-256 over concatenated strings, inner nodes over the lowercase hex text of their children.

Defined results: a null field is `-`; null groups are a group that comes first; rows without an id come first in their group;
rows that repeat an id are ordered by their leaf, equal rows are leaves of their own; the tampering expression's null means
no tampering; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import staged

ARITY = 8
LEVELS = 4
TOP_NODES = 1 << 14

PATH = "array<struct<place:int,run:array<string>>>"
ROWS = f"id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path {PATH}"
SUFFIX = f"grp string, block long, subroot string, path {PATH}"
ARROW_PATH = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.list_(pa.string()))]))

Path = list[tuple[int, list[str]]]


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def height(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def tower(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes and `steps` levels above them."""
    out = [nodes]
    for _ in range(steps):
        out.append([digest("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def climb(levels: list[list[str]], at: int) -> Path:
    """From node `at` of the lowest level to the top: its place in its run, and the run."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        out.append((at - first, level[first : first + ARITY]))
        at //= ARITY
    return out


def siblings(path: Path) -> str:
    return "".join("".join(run[:place]) + "".join(run[place + 1 :]) for place, run in path)


def fold(node: str, path: Path) -> str:
    for place, run in path:
        node = digest("".join(run[:place]) + node + "".join(run[place + 1 :]))
    return node


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", others: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """grp, id, leaf and, where `tampered` holds, altered: the leaf of the row with the text's A-Z lower-cased."""
    head = [field(F.col(c)) for c in (id_col, *others)]
    leaf = lambda text: F.unhex(F.sha2(F.concat(*head, field(text)), 256))
    lower = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # "-" comes before "="
    return docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf(F.col(text_col)).alias("leaf"), F.when(tampered, leaf(lower)).alias("altered"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(grp, ...) once each, with at (the first one's place in its group), times and n (rows of its group).

    Equal rows are one row before they are dealt to ranges, so no range is larger than its share.
    """
    columns = ["grp", *order]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    schema = counted.withColumn("part", F.lit(0)).withColumn("before", F.lit(0).cast("long")).schema

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            times = batch.column("times").to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(times)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(times), part, np.int32)), pa.array(ends - times)], [*batch.schema.names, "part", "before"])
            before = int(ends[-1]) if len(ends) else before

    dealt = counted.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = staged(dealt.mapInArrow(count_up, schema), "merkle-placed")
    bases, total = [], 0
    for part, rows_of in sorted(placed.groupBy("part").agg(F.sum("times")).collect()):  # one row per task
        bases.append((part, total))
        total += rows_of
    based = F.broadcast(rows.sparkSession.createDataFrame(bases, "part int, base long"))
    everywhere = placed.join(based, "part").withColumn("place", F.col("base") + F.col("before"))
    groups = everywhere.groupBy("grp").agg(F.min("place").alias("start"), F.sum("times").alias("n"))
    return everywhere.join(groups, "grp").select(*columns, (F.col("place") - F.col("start")).alias("at"), "times", "n")


def in_blocks(nodes: DataFrame, span: int) -> DataFrame:
    """nodes with block; a row that stands for several leaves is cut where blocks end."""
    at, last = F.col("at"), F.col("at") + F.col("times") - 1
    cut = nodes.withColumn("block", F.explode(F.sequence(F.floor(at / span), F.floor(last / span))))
    first = F.greatest(at, F.col("block") * span)
    return cut.withColumn("times", F.least(last, F.col("block") * span + span - 1) - first + 1).withColumn("at", first)


def spread(block: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, one per leaf, their nodes as hex, and the size of the group."""
    ordered = block.sort_by("at")
    repeated = ordered.take(pa.array(np.repeat(np.arange(len(ordered)), ordered["times"].to_numpy())))
    return repeated, [x.hex() for x in repeated["node"].to_pylist()], ordered["n"][0].as_py()


def reduced(members: DataFrame, levels: int) -> DataFrame:
    """One node per block of members(grp, block, at, times, n, node), as grp, at, n, node."""

    def up(block: pa.Table) -> pa.Table:
        _, nodes, n = spread(block)
        steps = min(levels, height(n))
        top = tower(nodes, steps)[-1]
        return pa.table({"grp": [block["grp"][0].as_py()], "at": [block["block"][0].as_py()], "n": [-(-n // ARITY**steps)], "node": [bytes.fromhex(top[0])]})

    return members.select("grp", "block", "at", "times", "n", "node").groupBy("grp", "block").applyInArrow(up, "grp string, at long, n long, node binary")


def top_tree(nodes: list, switched: bool) -> tuple[str | None, dict[tuple[str, int], tuple[str | None, Path]]]:
    """The root, and each node's group root and path. With `switched`, the nodes belong to the tree over the groups already."""
    groups: dict[str, list[str]] = {}
    for grp, _, node in sorted((r["grp"].encode(), r["at"], bytes(r["node"]).hex()) for r in nodes):
        groups.setdefault(grp.decode(), []).append(node)
    towers = {grp: tower(found, height(len(found))) for grp, found in groups.items()}
    roots = [levels[-1][0] for levels in towers.values()]
    over = tower(roots, height(len(roots)))
    paths = {}
    for place, (grp, levels) in enumerate(towers.items()):
        above = climb(over, place)
        for at in range(len(levels[0])):
            paths[grp, at] = (None if switched else levels[-1][0], climb(levels, at) + above)
    return (over[-1][0] if roots else None), paths


def _rows(found: pa.Table, node: list[str], full: list[Path], subroot: str, root: str, want_paths: bool) -> pa.Table:
    changed = [x if x is None else x.hex() for x in found["altered"].to_pylist()]
    folded = [fold(a or b, path) for a, b, path in zip(changed, node, full, strict=True)]
    told = [[{"place": p, "run": r} for p, r in path] for path in full] if want_paths else [None] * len(node)
    columns = [found["id"].combine_chunks(), node, [subroot] * len(node), [root] * len(node), [digest(siblings(path)) for path in full], folded, [x == root for x in folded], pa.array(told, ARROW_PATH)]
    return pa.table(dict(zip(("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"), columns, strict=True)))


def _suffixes(found: pa.Table, node: list[str], full: list[Path], subroot: str | None) -> pa.Table:
    """What the blocks below need; members of the tree over the groups are those groups' roots."""
    path = pa.array([[{"place": p, "run": r} for p, r in x] for x in full], ARROW_PATH)
    roots = pa.array(node if subroot is None else [subroot] * len(node), pa.string())
    return pa.table({"grp": found["below"].combine_chunks(), "block": found["below_at"].combine_chunks(), "subroot": roots, "path": path})


def proofs(rows: DataFrame, levels: int = LEVELS, top_nodes: int = TOP_NODES, paths: bool = True) -> DataFrame:
    """rows(grp, id, leaf, altered) with subroot, root, proof_sha256, folded_root, verified and (or null) path.

    path is the proof: from the leaf up, the place in a run and the run's digests. folded_root comes from the altered leaf
    where there is one, else from the leaf, and the original siblings.
    """
    span = ARITY**levels
    rounds = [(staged(in_blocks(ranked(rows, ["id", "leaf", "altered"]), span).withColumnRenamed("leaf", "node"), "merkle-leaves"), False)]
    switched = False
    while True:
        nodes = staged(reduced(rounds[-1][0], levels), "merkle-nodes")
        total, most = nodes.agg(F.count(F.lit(1)), F.max("n")).first()
        if total <= top_nodes:
            break
        below = nodes.select(F.col("grp").alias("below"), F.col("at").alias("below_at"), "grp", "at", "n", "node")
        to_groups = most == 1
        if to_groups:  # only groups' roots are left, and too many: they are the leaves of one more tree
            below = ranked(below.select(F.lit("").alias("grp"), "below", "below_at", "node"), ["below", "below_at", "node"])
        else:
            below = below.withColumn("times", F.lit(1).cast("long"))
        rounds.append((staged(in_blocks(below, span), "merkle-level"), to_groups))
        switched = switched or to_groups
    root, known = top_tree(nodes.collect(), switched)  # at most top_nodes rows
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def finish(last: bool, to_groups: bool) -> Callable[[pa.Table, str | None, Path], pa.Table]:
        def block_rows(block: pa.Table, subroot: str | None, suffix: Path) -> pa.Table:
            found, node, n = spread(block)
            tiers = tower(node, min(levels, height(n)))
            full = [climb(tiers, i) + suffix for i in range(len(node))]
            return _rows(found, node, full, subroot, root, paths) if last else _suffixes(found, node, full, None if to_groups else subroot)

        return block_rows

    def from_top(done: Callable[[pa.Table, str | None, Path], pa.Table]) -> Callable[[pa.Table], pa.Table]:
        return lambda block: done(block, *shared.value[block["grp"][0].as_py(), block["block"][0].as_py()])

    def from_above(done: Callable[[pa.Table, str | None, Path], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def both(block: pa.Table, suffix: pa.Table) -> pa.Table:
            told = suffix.to_pylist()[0]
            return done(block, told["subroot"], [(p["place"], p["run"]) for p in told["path"]])

        return both

    above = None
    for i, (members, to_groups) in reversed(list(enumerate(rounds))):
        done, schema, blocks = finish(i == 0, to_groups), ROWS if i == 0 else SUFFIX, members.groupBy("grp", "block")
        above = blocks.applyInArrow(from_top(done), schema) if above is None else blocks.cogroup(above.groupBy("grp", "block")).applyInArrow(from_above(done), schema)
    return above


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS, top_nodes: int = TOP_NODES, paths: bool = True) -> DataFrame:
    """proofs() of the rows of docs; `tampered` chooses the rows whose text is lower-cased before it is checked."""
    return proofs(leaves(docs, F.lit(False) if tampered is None else tampered), levels, top_nodes, paths)
