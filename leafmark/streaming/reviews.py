"""Streams of reviewer activity: our own extension of the batch operators.

Sessions with a watermark, a state per document that refuses illegal steps, and append-only lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmark.operators.passes import GAP_HOURS, named, pass_counts

# fixed values: the steps of a document's review, each with the states it may start from and the one it ends in
STATES = ("EMPTY", "DOC_LOADED", "PROMPT_READY", "AWAITING_RESPONSE", "VALIDATING", "VALIDATION_FAILED", "RATIFYING", "INJECTED")
STEPS = {
    "load_document": (("EMPTY",), "DOC_LOADED"),
    "load_persona": (STATES[1:], "PROMPT_READY"),
    "set_prompt": (("DOC_LOADED", "PROMPT_READY"), "PROMPT_READY"),
    "copy_prompt": (("PROMPT_READY",), "AWAITING_RESPONSE"),
    "submit_response": (("AWAITING_RESPONSE",), "VALIDATING"),
    "validation_failed": (("VALIDATING",), "VALIDATION_FAILED"),
    "acknowledge_failure": (("VALIDATION_FAILED",), "AWAITING_RESPONSE"),
    "chunk_passed": (("VALIDATING",), "PROMPT_READY"),
    "validation_passed": (("VALIDATING",), "RATIFYING"),
    "injected": (("RATIFYING",), "INJECTED"),
    "reset": (STATES, "EMPTY"),
}


def sessions(observations: DataFrame, late: str = "1 hour", gap_hours: int = GAP_HOURS) -> DataFrame:
    """Dated observations (a stream or a table) as passes: a session ends when a gap has gone by.

    A session window merges at a gap of exactly its length too. Undated observations have no event time: see `undated`.
    """
    dated = named(observations).filter("date is not null").withColumn("date", F.col("date").cast("timestamp"))
    window = F.session_window("date", f"{gap_hours} hours")
    return dated.withWatermark("date", late).groupBy("doc_id", "author", window.alias("session")).agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"), *pass_counts()).drop("session")


def undated(observations: DataFrame) -> DataFrame:
    return named(observations).filter("date is null")


def walk(state: str, steps: list[str]) -> Iterator[tuple[str, str, str, bool]]:
    """(step, before, after, legal) of each step; an illegal one leaves the state as it is."""
    for step in steps:
        allowed, after = STEPS.get(step, ((), state))
        legal = state in allowed
        yield step, state, after if legal else state, legal
        state = after if legal else state


def document_states(events: DataFrame) -> DataFrame:
    """events(doc_id, seq, step) as doc_id, seq, step, before, after, legal; the state is kept per document."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        now = state.get[0] if state.exists else "EMPTY"
        walked = list(walk(now, rows["step"].tolist()))
        state.update((walked[-1][2] if walked else now,))
        yield pd.DataFrame([(key[0], int(n), *w) for n, w in zip(rows["seq"], walked)], columns=["doc_id", "seq", "step", "before", "after", "legal"])

    return events.groupBy("doc_id").applyInPandasWithState(update, "doc_id long, seq long, step string, before string, after string, legal boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def append_lineage(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is to a table of files, each row once; aborted runs leave what they had written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
