"""The state of each document under review, with timers: our own extension, for streams with event time.

`reviews.document_states` keeps a state per document; here an abandoned document also goes back to EMPTY by itself, once the
watermark passes its last step by `idle`, and its last illegal steps are kept for diagnosis. State is a value (the state's
name and the timer that counts) and a bounded list, in the state store that `transformWithState` needs (RocksDB), so a
restarted query goes on where its checkpoint stands.

Defined results: an illegal or unknown step gives a row with legal false and leaves the state; rows of one batch are taken by
`at`, then seq; a row behind the watermark is still taken, since steps are numbered; null steps are illegal; null times don't
move the timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmark.streaming.reviews import walk

OUT = StructType([StructField("doc_id", LongType()), StructField("seq", LongType()), StructField("step", StringType()), StructField("before", StringType()), StructField("after", StringType()), StructField("legal", StringType()), StructField("refused", LongType())])
IDLE_MS = 14 * 24 * 3600 * 1000
MOST_REFUSED = 20
ABANDONED = "abandoned"


class DocumentStates(StatefulProcessor):
    """Steps of a document, each with the state before and after; an expired timer is a step of its own, without a number."""

    def __init__(self, idle_ms: int = IDLE_MS) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, timer long")
        self.refused = handle.getListState("refused", "step string")

    def _rows(self, key: tuple, walked: list[tuple]) -> pd.DataFrame:
        refused = [r[0] for r in self.refused.get()] if self.refused.exists() else []
        out = []
        for seq, step, before, after, legal in walked:
            if not legal:
                refused = [*refused, step or ""][-MOST_REFUSED:]
            out.append((key[0], seq, step, before, after, str(legal).lower(), len(refused)))
        if refused:
            self.refused.put([(r,) for r in refused])
        frame = pd.DataFrame(out, columns=OUT.names)
        return frame.astype({"seq": "Int64", "doc_id": "int64", "refused": "int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        name, timer = self.state.get() if self.state.exists() else ("EMPTY", 0)
        steps = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable", na_position="first")
        walked = [(int(n), *w) for n, w in zip(steps["seq"], walk(name, [None if pd.isna(s) else s for s in steps["step"]]), strict=True)]
        name = walked[-1][3]
        last = steps["at"].max()
        due = 0 if name == "EMPTY" else timer if pd.isna(last) else max(timer, int(pd.Timestamp(last).timestamp() * 1000) + self.idle_ms)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.state.update((name, due))
        yield self._rows(key, walked)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        name, _ = self.state.get() if self.state.exists() else ("EMPTY", 0)
        self.state.update(("EMPTY", 0))
        yield self._rows(key, [(None, ABANDONED, name, "EMPTY", True)])

    def close(self) -> None:
        """Nothing is held outside the state store."""


def document_reviews(events: DataFrame, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """events(doc_id, seq, step, at), a stream, as doc_id, seq, step, before, after, legal ("true", "false"), refused (so far kept)."""
    rows = events.select("doc_id", "seq", "step", "at").withWatermark("at", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(DocumentStates(idle_ms), OUT, "append", "eventTime")
