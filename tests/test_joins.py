"""Joins of written tables: none that grows with the input is broadcast by the size of its files."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from test_docx import note, package, para, ranged, run

from leafmark import staging
from leafmark.operators import passes as P
from leafmark.operators import threads as H
from leafmark.sources import docx, observed


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_written_tables_of_many_rows_are_merged(spark):
    rows = spark.range(70_000).select("id", F.lit("/in/the same long path.docx").alias("path"))
    many, few = staging.settled(rows), staging.settled(rows.limit(10))
    other = spark.range(3_000_000)
    assert "SortMergeJoin" in plan(many.join(other, "id")) and "Broadcast" not in plan(many.join(other, "id"))
    assert "Broadcast" in plan(few.join(other, "id"))


@pytest.fixture
def entries(spark, monkeypatch):
    """A package, of which every table counts as one of many rows."""
    monkeypatch.setattr(staging, "SMALL_ROWS", -1, raising=False)
    monkeypatch.setattr(H, "SMALL_ROWS", -1, raising=False)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "20k")  # above every file, below what Spark guesses of their joins
    body = para(run("One. "), ranged("0", "two"), run(" three."))
    yield staging.settled(spark.createDataFrame([("/in/a.docx", package(body, note(0, "A", "why", "P0")))], "path string, content binary"))
    spark.conf.unset(key)


def test_package_tables_are_merged(entries):
    rows, notes = staging.settled(docx.segments(entries)), docx.comments(entries)
    seen = observed.observations(entries)
    for df in (notes, docx.thread_texts(staging.settled(notes)), docx.preflight(rows, notes), seen, P.passes(observed.timed(staging.settled(seen))), observed.slices(entries, "2026-03-01")):
        assert "Join" in plan(df) and "Broadcast" not in plan(df)
    assert [r.kind for r in seen.collect()] == ["comment"]
