from __future__ import annotations

import datetime as dt

import pytest

from leafmark.streaming import reviews, states

SCHEMA = "doc_id long, seq long, step string, at timestamp"
START = dt.datetime(2026, 5, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_states_keep_timers_and_go_on_from_the_checkpoint(rocks, tmp_path):
    spark = rocks
    hour = lambda h: START + dt.timedelta(hours=h)

    def feed(n, rows):
        """One more file of events, then the query over what is new, started anew from its checkpoint."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events")
        out = states.document_reviews(stream, "1 hour", idle_ms=10 * 3600 * 1000)
        reviews.append_lineage(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return {(r.doc_id, r.seq, r.step): (r.before, r.after, r.legal, r.refused) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    got = feed(1, [(1, 2, "copy_prompt", hour(0)), (1, 1, "load_document", hour(0)), (1, 3, None, hour(1)), (2, 1, "load_document", hour(0))])
    assert got == {
        (1, 1, "load_document"): ("EMPTY", "DOC_LOADED", "true", 0),
        (1, 2, "copy_prompt"): ("DOC_LOADED", "DOC_LOADED", "false", 1),
        (1, 3, None): ("DOC_LOADED", "DOC_LOADED", "false", 2),
        (2, 1, "load_document"): ("EMPTY", "DOC_LOADED", "true", 0),
    }
    got = feed(2, [(1, 4, "set_prompt", hour(8)), (1, 5, "bogus", hour(8)), (3, 1, "reset", hour(8))])
    assert got[1, 4, "set_prompt"] == ("DOC_LOADED", "PROMPT_READY", "true", 2) and got[1, 5, "bogus"] == ("PROMPT_READY", "PROMPT_READY", "false", 3)
    got = feed(3, [(4, 1, "load_document", hour(14))])
    got = feed(4, [(4, 2, "set_prompt", hour(14))])
    # document 2 was left at 0:00, so it is abandoned when the watermark (13:00) passes 10:00; document 1 not before 18:00
    assert got[2, None, states.ABANDONED] == ("DOC_LOADED", "EMPTY", "true", 0) and (1, None, states.ABANDONED) not in got
    assert (3, None, states.ABANDONED) not in got
    got = feed(5, [(2, 2, "load_document", hour(30)), (2, 3, "load_document", hour(30))])
    got = feed(6, [(2, 4, "reset", hour(30))])
    assert got[2, 2, "load_document"] == ("EMPTY", "DOC_LOADED", "true", 0) and got[2, 3, "load_document"][2] == "false"
    assert got[1, None, states.ABANDONED] == ("PROMPT_READY", "EMPTY", "true", 3) and got[2, 4, "reset"][1] == "EMPTY"
