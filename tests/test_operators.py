from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmark.operators import anchors as A
from leafmark.operators import apply as Y
from leafmark.operators import blocks as B
from leafmark.operators import edits as E
from leafmark.operators import gates as G
from leafmark.operators import passes as P
from leafmark.operators import registry as R
from leafmark.operators import threads as H

DAY = dt.datetime(2026, 5, 1)


def observations(spark, rows):
    return spark.createDataFrame([(1, i, k, a, None if h is None else DAY + dt.timedelta(hours=h)) for i, (k, a, h) in enumerate(rows)], "doc_id long, doc_order long, kind string, author string, date timestamp")


def test_passes_split_on_gaps_and_route_undated(spark):
    rows = [("insertion", "A", 0), ("deletion", "A", 48), ("comment", "A", 97), ("comment-reply", "A", None), ("insertion", "B", 5), ("comment", "B", None), ("deletion", "", None), ("deletion", "", None)]
    got = {(r.author, r.pass_no): r for r in P.passes(observations(spark, rows)).collect()}
    assert set(got) == {("A", 0), ("A", 1), ("A", 2), ("B", 0), ("Unknown", 0)}
    assert got["A", 0].label == "A — 2026-05-01 (2 edits, 0 comments, 0 replies)"
    assert got["A", 2].label == "A — undated (0 edits, 0 comments, 1 reply)" and got["A", 2].undated
    assert got["B", 0].comments == 1 and got["Unknown", 0].label.startswith("Unknown — undated (2 edits")
    assert {r.pass_no for r in P.assign_passes(observations(spark, rows), 72).filter("author = 'A' and date is not null").collect()} == {0}


def test_stripped_metadata(spark):
    rows = [("insertion", "Author", None), ("comment", "Author", None)]
    assert [r.label for r in P.passes(observations(spark, rows)).collect()] == ["Author (metadata stripped)"]


def test_aliases_follow_to_the_end(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "alias string, canonical string")
    assert {(r.alias, r.canonical) for r in P.resolve_aliases(pairs).collect()} == {("a", "c"), ("b", "c"), ("x", "y")}


def test_threads_render_depth_first(spark):
    rows = [(1, 1, "A", "2026-07-02T10:00:00Z", True, "root", None), (1, 3, "B", None, None, "second", 1), (1, 2, "B", None, False, "first", 1), (1, 4, "C", None, False, "deep", 2)]
    df = spark.createDataFrame(rows, "doc_id long, comment_id long, author string, date string, done boolean, text string, parent_id long")
    assert H.render(df).first().thread == "{>>A (2026-07-02) [resolved]: root<<}{>>↳ B: first<<}{>>↳↳ C: deep<<}{>>↳ B: second<<}"
    assert tuple(H.totals(df).first()) == (1, 4, 3, 1)


def test_threads_of_any_depth_and_number(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(150)] + [(2, i, None if i % 2 == 0 else i - 1) for i in range(100)]
    rows += [(3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, 9), (3, 5, 4)]  # a cycle with a reply, and a parent that isn't there
    df = spark.createDataFrame(rows, "doc_id long, comment_id long, parent_id long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        got = {(r.doc_id, r.comment_id): (r.root_id, r.depth, r.path) for r in H.expand(df).collect()}
        every = sorted((r.root_id, r.comment_id, r.depth, r.path) for r in H.expand(df.filter("doc_id = 3"), every=True).collect())
        number = H.expand(df.filter("doc_id = 1"), every=True).count()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(1, i): (0, i, list(range(i + 1))) for i in range(150)} | {(2, i): (i - i % 2, i % 2, list(range(i - i % 2, i + 1))) for i in range(100)}
    assert every == [(1, 1, 0, [1]), (1, 2, 1, [1, 2]), (1, 3, 2, [1, 2, 3]), (2, 1, 1, [2, 1]), (2, 2, 0, [2]), (2, 3, 1, [2, 3]), (3, 3, 0, [3]), (4, 4, 0, [4]), (4, 5, 1, [4, 5]), (5, 5, 0, [5])]
    assert number == 150 * 151 // 2


def test_aliases_of_any_length_and_in_cycles(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("b", "c"), ("c", "a"), ("a", "b"), ("d", "c"), ("s", "s")]
    got = {r.alias: r.canonical for r in P.resolve_aliases(spark.createDataFrame(pairs, "alias string, canonical string")).collect()}
    assert got == {f"n{i}": "n60" for i in range(60)} | {k: "a" for k in "abcd"} | {"s": "s"}


def test_payload_between_first_fences(spark):
    lines = ["note", "```JSONL", " a ", "", "b", "```", "after", "```", "c"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)] + [(2, 0, " x "), (2, 1, "")] + [(3, 0, "```"), (3, 1, "open")], "doc_id long, line_no long, line string")
    got = E.payload_lines(df).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line) for r in got] == [(1, "a"), (1, "b"), (2, "x"), (3, "open")]


def test_coverage_counts_only_addressing_kinds(spark):
    comments = spark.createDataFrame([(1, 1, "AR_COMMENT_1"), (1, 2, " AR_COMMENT_2 "), (1, 3, "AR_COMMENT_2"), (1, 4, "AR_COMMENT_3"), (1, 5, " ")], "doc_id long, ordinal long, comment_id string")
    edits = spark.createDataFrame([(1, " Reply_To_Comment", "AR_COMMENT_1 "), (1, "replace_text", "AR_COMMENT_3")], "doc_id long, change_type string, bookmark_id string")
    assert [r.comment_id for r in E.unaddressed(comments, edits).orderBy("ordinal").collect()] == ["AR_COMMENT_2", "AR_COMMENT_2", "AR_COMMENT_3"]


def test_apply_order_and_cascade(spark):
    lines = [
        '{"bookmark_id":"P1","change_type":"replace_text","old_text":"a – b","new_text":"c"}',
        '{"bookmark_id":"P1","change_type":"rewrite","apply_change":false}',
        '{"bookmark_id":"P9","change_type":"delete_element"}',
        '{"bookmark_id":"P1","change_type":"accept_revision"}',
        "nonsense",
    ]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "doc_id long, line_no long, line string")
    paragraphs = spark.createDataFrame([(1, "P1", "x a - b y")], "doc_id long, anchor string, text string")
    got = [(r.pass_no, r.status, r.why, r.text_after) for r in Y.apply_plan(df, paragraphs).orderBy("line_no").collect()]
    assert got == [(1, "Applied", "", "x c y"), (1, "Skipped", "APPLY_FALSE", None), (1, "Skipped", "TARGET_NOT_FOUND", None), (2, "Applied", "", "x c y"), (1, "Skipped", "PARSE", None)]


def test_an_edit_that_meets_no_run_is_uncovered(spark):
    edits = spark.createDataFrame([(1, 0, 2, 4), (1, 1, 8, 9), (2, 0, 0, 3)], "doc_id long, edit_id int, md_start int, md_end int")
    runs = spark.createDataFrame([(1, 0, 0, 0, 5, 0)], "doc_id long, block_seq int, run_index int, md_start int, md_end int, char_offset int")
    none = spark.createDataFrame([], "doc_id long, s int, e int")
    got = {(r.doc_id, r.edit_id): (r.covered, r.error, len(r.triples)) for r in A.resolve_ranges(edits, runs, none).collect()}
    assert got == {(1, 0): (2, None, 1), (1, 1): (0, "synthetic", 0), (2, 0): (0, "synthetic", 0)}


def test_splice_equals_right_to_left(spark):
    rng = random.Random(12)
    docs, edits, want = [], [], {}
    for d in range(30):
        text = "".join(rng.choice("abc \n") for _ in range(rng.randrange(80)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(4)))
        own = [(a, z, rng.choice(["", "NEW", "x\ny"])) for a, z in zip(cuts[::2], cuts[1::2])]
        own = [e for i, e in enumerate(own) if i == 0 or e[0] > own[i - 1][1]]
        out = text
        for a, z, new in reversed(own):
            out = out[:a] + new + out[z:]
        docs.append((d, text))
        edits += [(d, a, z, new) for a, z, new in own]
        want[d] = out
    t, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(edits, "doc_id long, md_start long, md_end long, new_text string")
    assert {r.doc_id: r.text for r in E.splice(t, e).collect()} == want
    assert {r.doc_id: r.text for r in E.splice(t, e, accept=False).collect()} == dict(docs)


def test_snapping_over_marks(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 6, 8)], "doc_id long, s int, e int")
    edits = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 0, 2), (1, 2, 3, 5)], "doc_id long, edit_id int, md_start int, md_end int")
    assert [(r.snap_start, r.snap_end) for r in A.snap(edits, spans).orderBy("edit_id").collect()] == [(2, 6), (2, 2), (3, 5)]
    merged = A.merge_spans(spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 9), (1, 6, 7)], "doc_id long, s int, e int"))
    assert sorted((r.s, r.e) for r in merged.collect()) == [(0, 3), (5, 9)]


def test_merged_spans_are_sorted_once(spark):
    """Touching, nested, equal and single spans; none of them is hashed, or sorted again for the joins that follow."""
    rows = [(1, 0, 2), (1, 2, 3), (1, 3, 3), (1, 5, 20), (1, 6, 7), (1, 8, 9), (1, 20, 21), (2, 0, 1), (2, 0, 1), (2, 4, 5)]
    spans = spark.createDataFrame(rows, "doc_id long, s int, e int")
    merged = A.merge_spans(spans)
    assert sorted((r.doc_id, r.s, r.e) for r in merged.collect()) == [(1, 0, 3), (1, 5, 21), (2, 0, 1), (2, 4, 5)]
    edits = spark.createDataFrame([(1, 0, 2, 20)], "doc_id long, edit_id int, md_start int, md_end int")
    plan = A.snap(edits.hint("merge"), merged)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 3


def test_points_and_boundaries(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 7, 12)], "doc_id long, block_seq int, md_start int, md_end int")
    points = spark.createDataFrame([(1, i, p) for i, p in enumerate((0, 5, 6, 9, 12, 20))], "doc_id long, edit_id int, pos int")
    got = [(r.block_seq, r.edge) for r in A.resolve_boundaries(points, blocks).orderBy("edit_id").collect()]
    assert got == [(0, "before"), (0, "after"), (0, "after"), (None, None), (1, "after"), (1, "after")]


def response(spark, text, exported="# h\n\nalpha beta\n\ngamma", header=3):
    read = G.read_responses(spark.createDataFrame([(1, text, exported, header)], "doc_id long, response string, exported string, header_length int"))
    blocks = spark.createDataFrame([(1, 0, 5, 15), (1, 1, 17, 22)], "doc_id long, block_seq int, md_start int, md_end int")
    runs = spark.createDataFrame([(1, 0, 0, 5, 15, 0), (1, 1, 0, 17, 22, 0)], "doc_id long, block_seq int, run_index int, md_start int, md_end int, char_offset int")
    locked = spark.createDataFrame([(1, 19, 20)], "doc_id long, s int, e int")
    return G.verdicts(G.text_gates(read, blocks), G.anchor_gates(G.edits_of(read), runs, blocks, locked, locked)).first().gate


def test_each_fault_meets_its_gate(spark):
    assert response(spark, "# h\n\nalpha {--beta--}\n\ngamma{>>ok<<}") is None
    assert response(spark, "# h\n\nalpha beta\n{++new paragraph++}\ngamma") is None
    assert response(spark, "# x\n\nalpha beta\n\ngamma") == "G2"
    assert response(spark, "# h\n\nalpha bata\n\ngamma") == "G2"
    assert response(spark, "# h\n\nalpha {--be{++x++}ta--}\n\ngamma") == "G1"
    assert response(spark, "# h\n\nalpha {--beta\n\ngam--}ma") == "G1"
    assert response(spark, "# h\n\nalpha {++a\nb++}beta\n\ngamma") == "G1"
    assert response(spark, "# h\n\nalpha beta\n\n{--gamma--}") == "G4"
    assert response(spark, "# h\r\n\r\nalpha beta\r\n\r\ngamma") is None


def test_chunks_begin_at_the_second_heading(spark):
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(["pre", "# A", "x", "# B", "y", "# C"])], "doc_id long, line_no int, line string")
    got = B.chunks(B.offsets(lines, 2), F.startswith("line", F.lit("# "))).orderBy("line_no").collect()
    assert [(r.chunk_index, r.base_offset) for r in got] == [(0, 0), (0, 0), (0, 0), (1, 13), (1, 13), (2, 21)]


def test_table_markdown_pads_and_escapes(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b|c"), (1, 1, 0, " "), (1, 2, 0, "x"), (1, 2, 2, "z")], "table_id long, row_no int, cell_no int, text string")
    assert B.table_markdown(cells).first().markdown == "| a | b\\|c |   |\n| --- | --- | --- |\n|   |   |   |\n| x |   | z |"


def test_registry(spark):
    base = spark.createDataFrame([("Key", "1"), ("Other", "2")], "key string, value string")
    changes = spark.createDataFrame([(" KEY ", "3"), ("new", "4")], "key string, value string")
    assert sorted(map(tuple, R.upsert(base, changes, "key").collect())) == [("Key", "3"), ("Other", "2"), ("new", "4")]
    rows = spark.createDataFrame([("a", 100.0, 1), ("a", 100.0, 2)], "k string, v double, y int")
    r = R.present_value(rows, ["k"], "v", "y", 0.07).first()
    assert abs(r.pv - (100 / 1.07 + 100 / 1.07**2)) < 1e-9 and abs(r.annualized - 100) < 1e-9


def test_sessions_resume_or_stop(spark):
    docs = spark.createDataFrame([(1, "RATIFYING", "a.docx", b"\x00PK", "r", None), (2, "VALIDATING", "b.docx", b"x", "r", "G2")], "doc_id long, state string, filename string, content binary, response string, verdict string")
    decisions = spark.createDataFrame([(1, 2, "accept", True), (1, 0, "reject", False)], "doc_id long, edit_id int, decision string, reviewed boolean")
    saved = R.session_record(docs, decisions, "1")
    back = {r.doc_id: r for r in R.resume(saved, docs, "1").collect()}
    assert bytes(back[1].content) == b"\x00PK" and [d.edit_id for d in back[1].decisions] == [0, 2] and back[2].verdict == "G2"
    for other, version in ((docs.withColumn("verdict", F.lit("G1")), "1"), (docs, "2")):
        with pytest.raises(Exception, match="in the session of document"):
            R.resume(saved, other, version).collect()


def test_the_first_failing_chunk_stops(spark):
    chunks = spark.createDataFrame([(1, 0, None), (1, 1, "G2"), (1, 2, "G1"), (2, 0, None), (3, 0, None)], "doc_id long, chunk_index long, gate string")
    edits = spark.createDataFrame([(1, 0, "G4"), (2, 1, "G3"), (2, 0, None), (3, 0, None)], "doc_id long, edit_id long, gate string")
    assert {r.doc_id: (r.gate, r.chunk_index) for r in G.chunk_verdicts(chunks, edits).collect()} == {1: ("G2", 1), 2: ("G3", None), 3: (None, None)}


def test_authors_are_read_back(spark):
    runs = spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id long, text_edited boolean")
    seen = R.read_back(runs, spark.createDataFrame([(1, "LEAFMARK"), (1, "leafmark"), (2, "Me"), (3, "Leafmark")], "doc_id long, author string"), "Leafmark")
    assert {r.doc_id: r.author_seen for r in seen.collect()} == {1: True, 2: False, 3: None}
