"""Fingerprint queries against their SQL over texts that the driver's smaller tables don't hold."""

from __future__ import annotations

import duckdb
import pytest

from leafmark.plans import registry

TEXTS = ["", None, "a", "\0", "\0\0", "a\0b", "\U0001f600", "x\U0001f600y", "\U0001f468\u200d\U0001f469", "\r\n", "\ufeffx", "x" * 300 + "\U0001f600"]


@pytest.mark.parametrize("name", ["attested_exports", "fingerprint_documents"])
def test_odd_texts_have_the_fingerprints_of_the_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = set(oracle.execute(registry.oracle_sql()[name]).fetchall())
    assert got == want and len(want) == len(TEXTS)
