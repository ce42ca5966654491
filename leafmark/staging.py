"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='leafmark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of rows that a Python worker gets at once, where the session doesn't say: Spark's own 64 MB stand in both processes.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of bounded bytes, whatever the tables' sizes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows of a written table that a join may still broadcast by the size of its files. Repeated paths and marks take next to nothing
#: there and a hundred times as much on the driver.
SMALL_ROWS = 65_536


def settled(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder: readers take the columns and rows that they need, also after losing executors.

    Joins with more than SMALL_ROWS rows are merge joins, so the driver never holds a table that grows with the input.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept if kept.count() <= SMALL_ROWS else kept.hint("merge")
