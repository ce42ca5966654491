from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import clustering, line_dedup, merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# ---- line dedup

LINES = "id long, text string, n_lines string, extra int"


def line_rows():
    rng = random.Random(5)
    common = ["Shared line number one", "  SHARED line NUMBER one\r", "short", "\tAnother shared line\v", "anöther shäred line 😀"]
    rows = [(i, "\n".join(rng.choice(common + [f"own line of document {i}", ""]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(7, "Shared line number one\nsecond row of seven"), (None, "Shared line number one\nlost"), (None, "only here without id"), (None, "only here without id")]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n".join(f"very long text, line {k % 50}" for k in range(30000))), (104, "very long text, line 7"), (104, "very long text, line 7")]
    return rows


def brute_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        shared = [len(key(s)) >= 10 and len(holders[key(s)]) > 1 and i != min(x for x in holders[key(s)] if x is not None) for s in lines]
        out.append((i, len(lines), sum(shared), "\n".join(s for s, gone in zip(lines, shared, strict=True) if not gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rows = line_rows()
    got = line_dedup.drop_lines(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], LINES), "id")
    assert got.columns == ["id", "text", "extra", "n_lines", "n_dropped"]
    assert order((r.id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == order(brute_lines(rows))


def test_line_dedup_thresholds_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, "a line of three", "x", 0) for i in (1, 2, 3)] + [(4, "a line of one or two", "x", 0), (5, "a line of one or two", "x", 0)], LINES)
    assert {r.id: r.n_dropped for r in line_dedup.drop_lines(rows, "id", min_docs=3).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r.id: r.n_dropped for r in line_dedup.drop_lines(rows, "id", min_chars=16).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    assert line_dedup.drop_lines(rows.limit(0), "id").collect() == []
    assert [r.text for r in line_dedup.drop_lines(spark.createDataFrame([(1, None, "x", 0)], LINES), "id").collect()] == [None]
    with pytest.raises(ValueError):
        line_dedup.drop_lines(rows, "id", min_docs=1)


def test_line_dedup_is_native(spark):
    plan = line_dedup.drop_lines(spark.createDataFrame([(1, "a", "x", 0)], LINES).filter("id > 0"), "id")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("== Optimized Logical Plan ==")[1])


# ---- Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def tree_rows(n, languages, seed=1):
    rng = random.Random(seed)
    return [(i * 3 - 20, rng.choice([None, "", "Ein Text", "MIXED Case " * rng.randrange(1, 5), "ÄÖ 😀"]), rng.choice(languages), rng.choice([None, "s"]), rng.choice([None, 5])) for i in range(n)]


def brute_tree(rows, tampered):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(value, (r[0], r[3], r[2], r[4], text))))
    lower = lambda s: s if s is None else re.sub("[A-Z]", lambda m: m[0].lower(), s)

    def grow(nodes):
        """The root and each node's runs, from the bottom up."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p // 8 * 8 : p // 8 * 8 + 8]
                paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
            level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((members, *grow([leaf(r, r[1]) for r in members])))
    root, over = grow([t[1] for t in trees])
    out = []
    for (members, subroot, paths), above in zip(trees, over, strict=True):
        for r, path in zip(members, paths, strict=True):
            full = path + above
            node = leaf(r, lower(r[1]) if tampered(r[0]) else r[1])
            for left, right in full:
                node = sha("".join(left) + node + "".join(right))
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join("".join(a) + "".join(b) for a, b in full)), node, node == root))
    return out


@pytest.mark.parametrize(
    "n, languages, levels, top",
    [(1, ["en"], 4, 100), (9, [None], 4, 100), (700, ["en", "de", None, "", "z"], 2, 1000), (300, ["en", "de", None], 1, 4), (75, [f"l{i}" for i in range(40)] + [None], 1, 3), (40, ["x"], 1, 1)],
)
def test_manifest_matches_brute_force(spark, n, languages, levels, top):
    """With few top nodes allowed, blocks are reduced in rounds, and the groups' roots too."""
    rows = tree_rows(n, languages)
    rows += [(None, "no id", languages[0], "s", 1), rows[0], rows[0], (rows[0][0], "other text, same id", *rows[0][2:])] if n > 1 else []
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, levels, top).collect()
    want = brute_tree(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0)
    assert order(tuple(r)[:7] for r in got) == order(want)
    for r in got:
        assert sha(merkle.siblings([(p.place, p.run) for p in r.path])) == r.proof_sha256
        assert merkle.fold(r.leaf, [(p.place, p.run) for p in r.path]) == r.root


def test_manifest_of_repeated_rows_and_of_nothing(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    got = merkle.manifest(df, levels=2, top_nodes=10)
    assert got.count() == 5000 and got.filter("verified").count() == 5000 and got.select("leaf", "root").distinct().count() == 1
    assert merkle.manifest(df.limit(0)).collect() == []


# ---- clustering

VECTORS = "vec_id long, embedding array<float>, cluster string, distance int"


def vector_rows():
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] + rng.normal(size=64) * rng.choice([0.05, 1.0])]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(5, rows[9][1]), (None, rows[8][1])]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [0.0] * 63, [3e38] + [0.0] * 63]
    return rows, [(2000 + i, v) for i, v in enumerate(odd)]


def brute_clusters(rows, k, rounds):
    kept = [(i, np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64)) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1].tolist()))[:k]
    centroids = [c for _, c in first]
    assign = lambda: [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    found = assign()
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    return [(i, c, d, inertia[c], sum(inertia.values()), centroids[c].tolist()) for (i, _), (d, c) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("k, rounds", [(40, 5), (7, 2), (1000, 1)])
def test_clusters_match_brute_force(spark, k, rounds):
    rows, odd = vector_rows()
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], VECTORS).repartition(3)
    got = clustering.clusters(df, k=k, rounds=rounds)
    assert order(tuple(r) for r in got.collect()) == order(brute_clusters(rows, k, rounds))


def test_clusters_of_nothing(spark):
    assert clustering.clusters(spark.createDataFrame([(1, None, "x", 0)], VECTORS)).collect() == []


@pytest.mark.parametrize("scale", [1, 40, 1 << 17])
def test_screening_spares_distances_and_keeps_the_nearest(scale):
    """Vectors without structure, vectors near centroids, equal ones, and such with one large component."""
    rng = np.random.default_rng(2)
    centroids = rng.integers(-400, 400, (40, 64)) * scale
    near = centroids[rng.integers(0, 40, 1000)] + rng.integers(-60, 60, (1000, 64)) * scale
    vectors = np.concatenate([centroids, near, rng.integers(-900, 900, (1500, 64)) * scale, np.eye(64, dtype=np.int64)[:20] * clustering.LARGEST])
    centre = centroids.sum(axis=0) // 40
    held = clustering.compressed(vectors - centre)
    cluster, distance, measured = clustering.nearest(vectors, held, centroids, centre)
    every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
    assert (clustering.bounds(held, centroids - centre) <= every).all()
    assert measured < 0.1 * every.size
