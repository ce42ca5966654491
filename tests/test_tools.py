from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_docx import change, note, package, para, ranged, run

from leafmark.functions import tables as T
from leafmark.functions.jsonl import edit_of, pairs_of
from leafmark.functions.markup import tokenized
from leafmark.operators import edits as E
from leafmark.operators import labels as L
from leafmark.operators import sections as S
from leafmark.operators import sheets as H
from leafmark.sources import docx

# ---- labels


def answers(spark, lines, targets, before=()):
    rows = spark.createDataFrame([(1, *x) for x in lines], "doc_id long, payload_no int, line_no long, line string")
    known = spark.createDataFrame([(1, t) for t in targets], "doc_id long, label string")
    held = spark.createDataFrame([(1, t) for t in before], "doc_id long, label string")
    return L.answer(rows, known, held), rows, known, held


def test_each_label_is_answered_once(spark):
    lines = [
        (1, 1, "[C3] reply: Agreed — see §4.2: a | b. | recommend: resolve"),
        (1, 2, "  [R7] Recommend: ACCEPT | rationale: fits | terms"),
        (1, 3, "[C3] reply: again"),
        (1, 4, "[C9] reply: nobody"),
        (1, 5, "[C4] recommend: accept"),
        (1, 6, "[C4] rationale: x"),
        (1, 7, "[R8] rationale: x"),
        (1, 8, "[C4] reply: " + "x" * (L.MOST_CHARS + 1)),
        (1, 9, "Thanks!"),
        (1, 10, "[C4] reply: a | reply: b"),
        (1, 11, "[C4]"),
        (1, 12, None),
        (1, 13, "  "),
        (2, 1, "[C04] reply: late"),
        (2, 2, "[R7] recommend: reject"),
        (2, 3, "[C5] reply: was answered"),
    ]
    out, rows, known, held = answers(spark, lines, ["C3", "C4", "C5", "R7", "R8", "R8"], ["C5"])
    codes = {(r.payload_no, r.line_no): r.code for r in out.plan.collect()}
    assert codes == {
        (1, 1): "", (1, 2): "", (1, 3): "ALREADY_ADDRESSED", (1, 4): "UNKNOWN_LABEL", (1, 5): "UNKNOWN_RECOMMENDATION", (1, 6): "FIELD_NOT_ALLOWED", (1, 7): "RECOMMENDATION_MISSING",
        (1, 8): "TOO_LONG", (1, 9): "MALFORMED", (1, 10): "MALFORMED", (1, 11): "MALFORMED", (2, 1): "", (2, 2): "ALREADY_ADDRESSED", (2, 3): "ALREADY_ADDRESSED",
    }
    assert {(r.label, r.text, r.threaded) for r in out.comments.collect()} == {("C3", "Agreed — see §4.2: a | b.", True), ("R7", "Recommended: accept — fits | terms", False), ("C4", "late", True)}
    assert [r.label for r in out.resolved.collect()] == ["C3"]
    again = L.answer(rows, known, held.unionByName(out.addressed))
    assert again.comments.collect() == again.addressed.collect() == [] and again.plan.filter("code = ''").count() == 0
    empty, *_ = answers(spark, [], [])
    assert empty.plan.collect() == empty.comments.collect() == []


# ---- sheets


def test_cells_become_records(spark):
    cells = spark.createDataFrame([(1, ' {"a": 1, "b": "x", "c": 5} '), (2, None), (3, " "), (4, '{"a": 2'), (5, "[1]"), (6, '{"b": null}'), (7, '{"a": 1} x'), (8, '{"a": 1}, {"a": 2}')], "row_no int, json_line string")
    got = {r.row_no: (r.a, r.b, r._error) for r in H.records(cells, [("a", "double"), ("b", "string")]).collect()}
    assert got == {1: (1.0, "x", False), 4: (None, None, True), 5: (None, None, True), 6: (None, None, False), 7: (None, None, True), 8: (None, None, True)}


def test_wide_rows_become_long_and_are_looked_up(spark):
    wide = spark.createDataFrame([("N", 1.0, None), ("S", 3.0, 4.0), (None, 5.0, 6.0)], "Region string, Jan double, Feb double")
    long = H.melt(wide, ["Region"], ["Jan", "Feb"], "Month", "v")
    assert sorted((r.Region or "", r.Month, r.v) for r in long.collect() if r.v) == [("", "Feb", 6.0), ("", "Jan", 5.0), ("N", "Jan", 1.0), ("S", "Feb", 4.0), ("S", "Jan", 3.0)]
    names = spark.createDataFrame([("N", "North", 1), ("N", "Nord", 2), (None, "none", 3)], "Region string, Name string, extra int")
    assert {(r.Region, r.Name) for r in H.looked_up(wide, names, "Region", ["Name"]).collect()} == {("N", "Nord"), ("S", None), (None, None)}


def test_summaries_are_exact(spark):
    rng = random.Random(6)
    xs = [rng.choice([rng.randrange(5), rng.random() * 100]) * 1.0 for _ in range(501)]
    rows = [(x, -x if i % 3 else None, None, float("nan") if i else 2.0, 7) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(5)
    got = {r.variable: r for r in H.describe(df, list("abcde")).collect()}
    for name, values in (("a", xs), ("b", [r[1] for r in rows if r[1] is not None])):
        q = statistics.quantiles(values, n=4, method="inclusive")
        want = (len(values), statistics.fmean(values), statistics.stdev(values), min(values), *q, max(values))
        assert tuple(got[name])[1:] == pytest.approx(want)
    assert tuple(got["c"])[1:] == (0, *[None] * 7) and tuple(got["d"])[1:] == (1, 2.0, None, *[2.0] * 5) and got["e"].p50 == 7.0
    assert tuple(H.describe(df.limit(0), ["a"]).first()) == ("a", 0, *[None] * 7)


def test_correlations_take_complete_pairs(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0), (5.0, float("nan"), 5.0)]
    got = {(r.x, r.y): r.r for r in H.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "b"] == got["b", "a"] and got["a", "c"] is None and got["c", "c"] is None and len(got) == 9


# ---- SQL


def test_table_functions_equal_the_columns(spark):
    T.register(spark)
    docs = spark.createDataFrame([(1, "a{++b++}c{~~d~>e~~}\n{--f--}"), (2, "{++a{--b--}++}"), (3, None), (4, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("docs")
    read = docs.select("doc_id", tokenized(F.col("text")).alias("r"))
    want = {(r.doc_id, i, t.type, t.raw_start, t.md_end, t.new_text, t.whole_paragraph) for r in read.collect() for i, t in enumerate(r.r.tokens or [])}
    got = spark.sql("SELECT d.doc_id, t.* FROM docs d, LATERAL markup_tokens(d.text) t").collect()
    assert {(r.doc_id, r.edit_id, r.type, r.raw_start, r.md_end, r.new_text, r.whole_paragraph) for r in got if r.error is None} == want
    assert [(r.doc_id, r.error_at) for r in got if r.error] == [(2, read.filter("doc_id = 2").first().r.error_at)]

    lines = spark.createDataFrame([(1, '{"bookmark_id":"A","change_type":"x","apply_change":false,"new_text":"\\u00e9"}'), (2, '{"bookmark_id":1,"change_type":"x"}'), (3, None), (4, "{}")], "line_no long, line string")
    lines.createOrReplaceTempView("edit_lines")
    want = {r.line_no: r.e and tuple(r.e) for r in lines.select("line_no", edit_of(pairs_of(F.col("line"))).alias("e")).collect()}
    got = {r.line_no: tuple(r)[1:8] if r.parsed else None for r in spark.sql("SELECT l.line_no, e.* FROM edit_lines l, LATERAL edit_line(l.line) e").collect()}
    assert got == want and want[1] is not None

    pasted = [(1, 1, "prose"), (1, 2, " ```json"), (1, 3, "{} "), (1, 4, ""), (1, 5, "```"), (1, 6, "more"), (2, 1, "x"), (2, 2, None), (2, 3, "y"), (3, 2, "late"), (3, 1, "```"), (4, 1, "```"), (4, 2, "```")]
    payload = spark.createDataFrame(pasted, "doc_id long, line_no long, line string")
    payload.createOrReplaceTempView("pasted")
    got = spark.sql("SELECT * FROM payload_lines(TABLE(SELECT doc_id, line_no, line FROM pasted) PARTITION BY doc_id ORDER BY line_no)").collect()
    known = E.payload_lines(payload.na.fill("", ["line"])).select("doc_id", "line_no", "line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, known)) == [(1, 3, "{}"), (2, 1, "x"), (2, 3, "y"), (3, 2, "late")]


# ---- anchors and sections

FEET = '<w:footnotes xmlns:w="urn:w"><w:footnote w:type="separator" w:id="-1"/><w:footnote w:id="5"><w:p><w:r><w:t>First note</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p/></w:footnote></w:footnotes>'


def noted(spark):
    import io
    import zipfile

    ref = lambda i: f'<w:r><w:footnoteReference w:id="{i}"/></w:r>'
    cell = lambda s, more="": f"<w:tc>{para(run(s))}{more}</w:tc>"
    body = (
        para(run("Title"), style="Heading1") + para() + para(run("Para "), change("del", "old"), change("ins", "new"), change("ins", "er"), run(" end."), ref(5))
        + f"<w:tbl><w:tr>{cell('a', para(change('ins', 'b', author='B')))}{cell('')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>" + para(run("One. "), ranged("0", "Two words"), run(" here. Three."), ref(2), ref(7))
        + f"<w:tbl><w:tr>{cell('e')}</w:tr></w:tbl>" + para(run("item"), level=0) + para()
    )
    out = io.BytesIO(package(body, note(0, "A", "Why  so?", "P0")))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/footnotes.xml", FEET)
    return docx.parts(spark.createDataFrame([("/n.docx", out.getvalue()), ("/plain.docx", package(para()))], "path string, content binary"))


def test_anchors_count_places(spark):
    entries = noted(spark)
    got = {(r.path, r.anchor): r.text for r in S.anchors(docx.segments(entries), docx.footnotes(entries)).collect()}
    assert got == {
        ("/n.docx", "AR_PARA_00001"): "Title", ("/n.docx", "AR_PARA_00003"): "Para newer end.", ("/n.docx", "AR_PARA_00004"): "a", ("/n.docx", "AR_PARA_00005"): "b", ("/n.docx", "AR_PARA_00007"): "c",
        ("/n.docx", "AR_PARA_00008"): "d", ("/n.docx", "AR_PARA_00009"): "One. Two words here. Three.", ("/n.docx", "AR_PARA_00010"): "e", ("/n.docx", "AR_PARA_00011"): "item",
        ("/n.docx", "AR_CELL_1_1_1"): "a\rb", ("/n.docx", "AR_CELL_1_2_1"): "c", ("/n.docx", "AR_CELL_1_2_2"): "d", ("/n.docx", "AR_CELL_2_1_1"): "e", ("/n.docx", "AR_FN_001"): "First note",
        ("/n.docx", "AR_REV_00001"): "old", ("/n.docx", "AR_REV_00002"): "newer", ("/n.docx", "AR_REV_00003"): "b",
    }


def test_a_gap_in_revision_anchors_stops_the_job(spark):
    changes = S.revisions(docx.segments(noted(spark)))
    found = S.revision_anchors(changes)
    assert [r.anchor for r in S.counted(found, changes).orderBy("place").collect()] == [f"AR_REV_0000{i}" for i in (1, 2, 3)]
    for gap in (found.filter("place != 2"), found.limit(0), found.withColumn("anchor", F.lit("AR_REV_00001"))):
        with pytest.raises(Exception, match="differ in /n.docx"):
            S.counted(gap, changes).collect()


def test_sections_show_what_the_package_holds(spark):
    entries = noted(spark)
    got = {(r.path[1], r.section): r.text for r in S.export_sections(docx.segments(entries), docx.comments(entries), docx.footnotes(entries)).collect()}
    lines = lambda *x: "\r\n".join(x) + "\r\n"
    framed = lambda name, body: f"<<{name}_START>>\r\n{body}<<{name}_END>>\r\n\r\n"
    assert got["n", "DOCUMENT_TEXT"] == framed("DOCUMENT_TEXT", "\r\n\r\n".join(["# Title", "Para newer end.", "a", "b", "c", "d", "One. Two words here. Three.", "e", "- item"]) + "\r\n\r\n")
    assert got["n", "FOOTNOTES"] == framed("FOOTNOTES", lines("## Footnote 1", "Anchor: Para newer end.", "Text: First note", "---", *[x for n in (2, 3) for x in (f"## Footnote {n}", "Anchor: One. Two words here. Three.", "Text: ", "---")]))
    assert got["n", "COMMENTS"] == framed("COMMENTS", lines("## AR_COMMENT_1", "Author: A", "Date: 2026-07-02T10:00:00Z", "Scope Sentence: Two words here.", "Highlight: Two words", "Text: Why so?", "---"))
    assert got["n", "REVISIONS"].split("\r\n")[7:13] == ["## AR_REV_00002", "Author: Reviewer A", "Date: 2026-07-01T09:00:00Z", "Type: Insertion", "Text: newer", "---"]
    assert got["n", "BOOKMARK_INDEX"].count(" | type=") == 14 and 'AR_CELL_1_1_1 | type=table_cell | "a b"' in got["n", "BOOKMARK_INDEX"]
    assert got["p", "DOCUMENT_TEXT"] == framed("DOCUMENT_TEXT", "") and got["p", "COMMENTS"] == framed("COMMENTS", lines("(No comments in document)")) and ("p", "FOOTNOTES") not in got
    assert got["p", "BOOKMARK_INDEX"] == framed("BOOKMARK_INDEX", lines("(No AR bookmarks found in document)")) and got["p", "REVISIONS"] == framed("REVISIONS", lines("(No revisions in document)"))


def test_lines_are_read_once_for_two_runs(spark):
    """Rows that were checked serve a second run without being read again, and it changes nothing."""
    from leafmark.operators import labels

    lines = spark.createDataFrame([(1, 0, 0, "[C1] reply: a"), (1, 0, 1, "[C01] reply: b"), (1, 0, 2, "[R2] recommend: accept"), (1, 1, 0, "[C9] reply: x")], "doc_id long, payload_no int, line_no long, line string")
    targets = spark.createDataFrame([(1, "C1"), (1, "R2")], "doc_id long, label string")
    rows = labels.checked(lines, targets)
    first = labels.answered(rows)
    assert sorted(r.label for r in first.addressed.collect()) == ["C1", "R2"]
    again = labels.answered(rows, first.addressed)
    assert "regexp" not in again.plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.label, r.code) for r in again.plan.collect()) == [("C1", "ALREADY_ADDRESSED"), ("C1", "ALREADY_ADDRESSED"), ("C9", "UNKNOWN_LABEL"), ("R2", "ALREADY_ADDRESSED")]
    assert again.comments.collect() == [] and again.addressed.collect() == []
