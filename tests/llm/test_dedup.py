from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmark.llm import exact_dedup, fuse_filter, simhash
from leafmark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SCHEMA)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, "x"), (4, "x"), (7, "long " * 40000), (8, "long\n" * 40000), (None, "x"), (None, "alone"), (6, " a b"), (50, "new"), (51, "new")]


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_filter_has_no_false_negatives(keys):
    held = np.array(sorted(keys), dtype=np.uint64)
    assert fuse_filter.contains(held, *fuse_filter.build(held)).all()


def test_filter_rejects_most_others():
    rng = np.random.default_rng(3)
    held, others = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (20000, 50000))
    built = fuse_filter.build(held)
    assert fuse_filter.contains(others, *built).mean() < 0.001
    assert len(built[3]) * 8 / len(held) < 24


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out, kept = [], set()
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        stays = i == keep and (norm(t), i) not in kept
        kept |= {(norm(t), i)} if stays else set()
        out.append((i, keep, len(groups[norm(t)]), stays, hashlib.sha256(norm(t).encode()).digest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_exact_dedup_matches_brute_force(spark):
    got = exact_dedup.decisions(docs_of(spark, ROWS)).select("id", "keep_id", "group_size", "kept", "digest").collect()
    assert order((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == order(brute(ROWS))


def test_exact_dedup_small_filters(spark):
    rows = [(i, f"t{i % 70}") for i in range(200)]
    snapshot = exact_dedup.build_snapshot(exact_dedup.digest_rows(docs_of(spark, rows), "doc_id", "text").filter("not is_new"), filter_keys=16)
    assert snapshot.buckets > 1 and snapshot.filters.count() == snapshot.digests.select("bucket").distinct().count()
    screened = exact_dedup.screen(snapshot.digests.select("digest", "first_id", "copies"), snapshot)
    assert screened.count() == 70 and screened.filter("maybe").count() == 70


def test_drop_copies_keeps_columns_and_one_row_of_each(spark):
    docs = docs_of(spark, ROWS)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert order([(r.doc_id,) for r in out.collect()]) == order([(r[0],) for r in brute(ROWS) if r[3]])


def test_hits_need_texts_of_their_own_digest(spark):
    docs = docs_of(spark, [(1, "a"), (2, "a")])
    hits = spark.createDataFrame([(bytes(32), 1, 2)], "digest binary, new_id long, old_id long")
    texts = exact_dedup.byte_checked(hits, docs, "doc_id", "text")
    assert texts.count() == 0


@pytest.mark.parametrize("run", [lambda d: exact_dedup.decisions(d), lambda d: exact_dedup.drop_copies(d), lambda d: simhash.groups(d), lambda d: simhash.keep_one(d)])
def test_empty_table(spark, run):
    assert run(docs_of(spark, [])).count() == 0


def reference_fingerprint(text, words=4):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", " ", "One", "ONE two\tthree", "a b c d e f g a b c d", "É é x y z", "w " * 5000):
        assert simhash.fingerprint(text.encode()) == reference_fingerprint(text)


def near_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(40)]
    for k in range(60):  # near copies: one word changed
        parts = base[k % 3].split()
        parts[int(rng.integers(len(parts)))] = f"new{k}"
        rows.append((100 + k, " ".join(parts)))
    return rows + [(500, None), (501, ""), (502, "short"), (503, "Short"), (None, "short"), (None, None)]


@pytest.mark.parametrize("hot_run", [simhash.HOT_RUN, 3])
def test_simhash_components_match_brute_force(spark, hot_run):
    rows = near_rows()
    prints = [reference_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    lowest = {}
    for i, (k, _) in enumerate(rows):
        lowest.setdefault(find(i), []).append(k)
    want = [(k, prints[i], min((x for x in lowest[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)]
    got = [(r.id, r.fp % 2**64, r.component_id) for r in simhash.groups(docs_of(spark, rows), hot_run=hot_run).collect()]
    assert order(got) == order(want)
    assert simhash.keep_one(docs_of(spark, [r for r in rows if r[0] is not None])).count() == len({w[2] for w in want if w[0] is not None})


def test_every_pair_within_four_bits_shares_a_variant(spark):
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(40):
        fp = int(rng.integers(0, 2**63))
        other = fp
        for bit in rng.choice(64, size=int(rng.integers(0, 5)), replace=False):
            other ^= 1 << int(bit)
        pairs.append((fp, other - (1 << 64) if other >= 1 << 63 else other))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    assert df.filter(F.arrays_overlap(simhash.variants(F.col("a")), simhash.variants(F.col("b")))).count() == len(pairs)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)] + [(5, 4)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
