"""Every registered query of the core against its SQL, over the driver's smaller tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from leafmark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that open packages, fold or scan much take the smallest tables, for time's sake; the others those of the correctness gate.
SMALL = ("docx_", "package_", "export_", "comments_added", "format_changes", "part_checksums", "applied_", "answered_", "chunked_", "sheet_", "sql_", "word_diff", "accept_all", "reject_all", "minimal_span")
DATA = os.environ.get("LEAFMARK_TESTDATA", "/root/testdata")

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    held = {}
    for scale in ("sf0.001", "sf0.01"):
        held[scale] = duckdb.connect()
        for t in TABLES:
            held[scale].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{scale}/{t}.parquet')")
    return held


def shown(value):
    """A value as text in which both engines' types agree."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str(sorted((k, shown(v)) for k, v in value.items()))
    return str([shown(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    scale = "sf0.001" if name.startswith(SMALL) else "sf0.01"
    df = registry.queries()[name](spark, f"{DATA}/{scale}")
    columns = sorted(df.columns)
    result = oracle[scale].execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want
    assert want
