from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import duckdb
import pytest
from leafmark.llm import queries
from tests_support import reference_groups

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text or "") for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
            after = sorted(r.doc_id for r in docs.collect())
        if k == 1:
            first = {}
            for i, t in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert after == sorted(first.values())
        if k == 2:
            assert after == sorted(set(reference_groups(before).values()))
        if k == 3:
            assert set(after) <= {i for i, _ in before} and max(after.count(i) for i in set(after)) <= 3
        if k == 4:
            texts = dict(before)
            assert len(before) == seen[-1]
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())
    assert seen[0] < 200 and seen[1] <= seen[0] and seen[2] <= seen[1]


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_centroid_clustering"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in result.fetchall())
    assert sorted(names) == sorted(df.columns) and want
    assert sorted(tuple(str(x) for x in r) for r in df.collect()) == want
