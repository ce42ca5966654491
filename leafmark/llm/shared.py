"""Tables in the folder that driver and executors share; every operator cuts its lineage here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space of the corpus contracts: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='leafmark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table: computed once, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python worker gets at once, where the session doesn't say: Spark's own 64 MB stand in both processes.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder; rows go to Python in batches of bounded bytes from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table, ids and digests, that a join may broadcast: some tens of MB.
BROADCAST_ROWS = 1 << 18


def join_side(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df written, with the hint of its counted size: broadcast up to `most` rows, else a merge join, which AQE splits."""
    kept = staged(df, name)
    return kept.hint("broadcast" if kept.count() <= most else "merge")
