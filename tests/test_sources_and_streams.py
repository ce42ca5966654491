from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leafmark.operators import render as N
from leafmark.sources import persona
from leafmark.streaming import reviews

FILE = """---
name: Careful Reader
description: >-
  reads
  twice
assistantUrl: http://x/
---
# Title
intro
## Role & Voice
calm
## Review Priorities
1. facts
## Style exemplars
Before: long
After: short

- before: x
- after: y
## Do-not-touch list
- names
2) dates

## Comment conventions
brief"""


def test_persona_files(spark):
    files = spark.createDataFrame([("/p/a.md", FILE.replace("\n", "\r\n")), ("/p/b.md", "## Style Exemplars\nBefore: only"), ("/p/c.md", "# Named\nno front"), ("/p/d.md", "")], "path string, text string")
    got = {r.path[3]: r for r in persona.personas(files).collect()}
    a = got["a"]
    assert (a.name, a.role_and_voice, a.review_priorities, a.comment_conventions, a.assistant_url, a.warnings) == ("Careful Reader", "calm", "1. facts", "brief", "http://x/", [])
    assert [(e.before, e.after, e.raw) for e in a.style_exemplars] == [("long", "short", None), ("x", "y", None)] and a.do_not_touch == ["names", "dates"]
    assert got["b"].name == "b" and [e.raw for e in got["b"].style_exemplars] == ["Before: only"] and len(got["b"].warnings) == 4
    assert got["c"].name == "Named" and got["d"].name == "d" and got["d"].do_not_touch == [] and got["d"].style_exemplars == []
    assert {(r.key, r.value) for r in persona.front_matter(files).filter("path = '/p/a.md'").collect()} == {("name", "Careful Reader"), ("description", "reads twice"), ("assistantUrl", "http://x/")}


def test_document_states_refuse_illegal_steps():
    steps = ["load_document", "copy_prompt", "set_prompt", "copy_prompt", "submit_response", "validation_failed", "acknowledge_failure", "bogus", "reset"]
    assert [w[3] for w in reviews.walk("EMPTY", steps)] == [True, False, True, True, True, True, True, False, True]


def test_streams_end_to_end(spark, tmp_path):
    day = dt.datetime(2026, 5, 1)
    rows = [(1, i, "insertion", "A", None if h is None else day + dt.timedelta(hours=h)) for i, h in enumerate((0, 10, 100, 400, None))]
    obs = spark.createDataFrame(rows, "doc_id long, doc_order long, kind string, author string, date timestamp")
    obs.write.parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/obs")
    query = reviews.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.window_start - day).total_seconds() / 3600 for r in spark.table("sessions").collect()} == {0, 100}
    assert reviews.sessions(obs).count() == 3 and reviews.undated(obs).count() == 1

    events = spark.createDataFrame([(1, 1, "load_document"), (1, 2, "submit_response"), (2, 1, "reset")], "doc_id long, seq long, step string")
    events.write.parquet(f"{tmp_path}/events")
    states = reviews.document_states(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    reviews.append_lineage(states, f"{tmp_path}/lineage", f"{tmp_path}/c2").awaitTermination()
    assert sorted((r.doc_id, r.seq, r.after, r.legal) for r in spark.read.parquet(f"{tmp_path}/lineage").collect()) == [(1, 1, "DOC_LOADED", True), (1, 2, "DOC_LOADED", False), (2, 1, "EMPTY", True)]


def test_slices_show_own_changes_and_accept_others(spark):
    segments = spark.createDataFrame(
        [(1, 0, 0, "text", "a ", None, True, False, None), (1, 0, 1, "ins", "mine", None, None, None, "7"), (1, 0, 2, "del", "theirs", None, None, None, "8"), (1, 0, 3, "sub", "old", "new", None, None, "8"), (1, 0, 4, "locked", "[x]", None, None, None, None)],
        "doc_id long, para_no int, seg_no int, t string, text string, new_text string, bold boolean, italic boolean, id string",
    )
    passes = spark.createDataFrame([(1, 0, "7"), (1, 1, "8")], "doc_id long, pass_no long, id string")
    assert {r.pass_no: r.text for r in N.slice_paragraphs(segments, passes).collect()} == {0: "**a** {++mine++}new[x]", 1: "**a** mine{--theirs--}{~~old~>new~~}[x]"}


def test_slice_threads_hold_parents(spark):
    notes = spark.createDataFrame([(1, 1, None, "A", "2026-07-02T10:00:00Z", False, "root"), (1, 2, 1, "B", None, False, "reply"), (1, 3, 1, "C", None, False, "other")], "doc_id long, comment_id long, parent_id long, author string, date string, done boolean, text string")
    members = spark.createDataFrame([(1, 0, 2)], "doc_id long, pass_no long, comment_id long")
    assert N.slice_threads(notes, members).first().thread == "{>>A [2026-07-02]: root<<}{>>↳ reply to A — B [undated]: reply<<}"


def test_prompts_and_repairs(spark):
    docs = spark.createDataFrame([(1, 0, 2, "h1\nh2", "body"), (1, 1, 2, "h1\nh2", "rest")], "doc_id long, chunk_index long, chunks long, header string, text string")
    first, second = (r.prompt for r in N.prompts(docs, *[F.lit(x) for x in ("p", "t", "g", "c")]).orderBy("chunk_index").collect())
    assert first == "[PERSONA]\np\n\n[TASK]\nThis is part 1 of 2.\nt\n\n[GRAMMAR]\ng\n\n[CONSTRAINTS]\nc\n- Begin with these exact lines:\n    h1\n    h2\n\n[DOCUMENT]\n```markdown\nbody\n```"
    assert "exact lines" not in second and "part 2 of 2" in second
    failures = [(1, "G1", "m", "x" * 200, 100, 2, None), (2, "G2", "m", "", None, 1, (3, "a", "b")), (3, "G5", "m", "", None, 1, None)]
    told = N.repair_messages(spark.createDataFrame(failures, "doc_id long, gate string, message string, response string, at int, attempts int, divergence struct<offset:int,after_a:string,after_b:string>"))
    a, b, c = (r.repair for r in told.orderBy("doc_id").collect())
    assert a == f'{N.AFRESH}m\nNear: "…{"x" * 160}…"\n{N.ADVICE["G1"]}'
    assert b == f'm\nIt differs from place 3 on.\nYou wrote: "a"\nExpected: "b"\n{N.ADVICE["G2"]}' and c == "m"


def test_persona_sections_are_found_once(spark):
    """Title and sections come from one pass over the lines, so a task holds no third sorted copy of them."""
    from leafmark.sources import persona

    files = spark.createDataFrame([("/p/a.md", "# A\n## Role\nr\n# Style exemplar\nraw\n"), ("/p/b.md", "no heading"), ("/p/c.md", "## Role\nx")], "path string, text string")
    out = persona.personas(files)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert sorted((r.name, r.role_and_voice, len(r.style_exemplars), len(r.warnings)) for r in out.collect()) == [("A", "r", 1, 3), ("b", "", 0, 5), ("c", "x", 0, 4)]
