"""Review-shaped inputs derived from the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.staging import in_small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    in_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every document; null texts are empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts with anchors, typographic marks, tabs and wide gaps set into them."""
    dressed = F.concat(F.lit(" AR_PARA_00012 \u201c"), F.replace("text", F.lit(", "), F.lit(" \u2014 AR_REV_00001  ")), F.lit("\u201d\tit\u2019s \\ \"a\"\r\nend\u00a0AR_CELL_1_2_3"))
    return texts(spark, sf_dir).select("doc_id", dressed.alias("text"))


TYPESET = """typeset AS (
  SELECT doc_id, ' AR_PARA_00012 \u201c' || replace(coalesce(text, ''), ', ', ' \u2014 AR_REV_00001  ') || '\u201d' || chr(9) || 'it\u2019s \\ "a"' || chr(13) || chr(10) || 'end\u00a0AR_CELL_1_2_3' AS text
  FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0) and line of every document's text."""
    return texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


LINES = """lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer activity from events: a document per hundred users, undated where the event is an error."""
    kind = F.when(F.col("event_type") == "view", "insertion").when(F.col("event_type") == "click", "deletion").when(F.col("event_type") == "signup", "comment-reply").otherwise("comment")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 100).alias("doc_id"),
        F.col("event_id").alias("doc_order"),
        kind.alias("kind"),
        F.when(F.col("user_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("reviewer "), F.col("user_id").cast("string"))).alias("author"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("date"),
    )


OBSERVATIONS = """observations AS (
  SELECT user_id // 100 AS doc_id, event_id AS doc_order,
         CASE event_type WHEN 'view' THEN 'insertion' WHEN 'click' THEN 'deletion' WHEN 'signup' THEN 'comment-reply' ELSE 'comment' END AS kind,
         CASE WHEN user_id % 11 = 0 THEN '' ELSE 'reviewer ' || user_id END AS author,
         CASE WHEN event_type != 'error' THEN ts END AS date
  FROM events)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment threads from conversations: each turn answers turn (turn - 1) / 2, the first is the root."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        turn.alias("comment_id"),
        F.coalesce("role", F.lit("Unknown")).alias("author"),
        F.when(turn % 3 != 2, F.concat(F.lit("2026-07-0"), (turn % 9 + 1).cast("string"), F.lit("T08:30:00Z"))).alias("date"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(turn % 4 != 3, turn % 2 == 1).alias("done"),
        F.when(turn > 0, F.floor((turn - 1) / 2)).alias("parent_id"),
    )


COMMENTS = """comments AS (
  SELECT conv_id AS doc_id, turn AS comment_id, coalesce(role, 'Unknown') AS author,
         CASE WHEN turn % 3 != 2 THEN '2026-07-0' || (turn % 9 + 1) || 'T08:30:00Z' END AS date, coalesce(text, '') AS text,
         CASE WHEN turn % 4 != 3 THEN turn % 2 = 1 END AS done, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent_id
  FROM conversations)"""
