"""Sections move only the paragraphs that they need: what segments tell of their paragraphs, and the same sections without it."""

from __future__ import annotations

import contextlib
import io
import zipfile

import pytest
from test_docx import change, note, package, para, ranged, run

from leafmark.operators import sections as S
from leafmark.sources import docx
from leafmark.staging import settled

FEET = '<w:footnotes xmlns:w="urn:w"><w:footnote w:id="5"><w:p><w:r><w:t>First note</w:t></w:r></w:p></w:footnote></w:footnotes>'
TOLD = ["tracked", "segs", "para_seq", "noted", "feet"]


def mark(kind, i):
    return f'<w:commentRange{kind} w:id="{i}"/>'


@pytest.fixture(scope="module")
def entries(spark):
    cell = lambda *inner: f"<w:tc>{para(*inner)}</w:tc>"
    body = (
        para(run("Plain. "), '<w:r><w:footnoteReference w:id="5"/></w:r>') + para(run("Zero. "), ranged("0", "Two words"), run(" here.")) + para()
        + para(run("Begins. "), mark("Start", 1), run("one ")) + f"<w:tbl><w:tr>{cell(run('in a cell'))}{cell(change('ins', 'put'), run(' in'))}</w:tr></w:tbl>" + para(run("two"), mark("End", 1), run(" behind"))
        + para(mark("End", 2), run("ends before"), change("del", "it"), change("ins", "that")) + para(mark("Start", 2), run("it begins")) + para(mark("Start", 3), run("never ends")) + para(run("last"))
    )
    notes = "".join(note(i, "A", f"why {i}", f"P{i}") for i in range(5))
    out = io.BytesIO(package(body, notes))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/footnotes.xml", FEET)
    return settled(spark.createDataFrame([("/n.docx", out.getvalue()), ("/plain.docx", package(para()))], "path string, content binary"))


def test_segments_tell_of_their_paragraphs(entries):
    rows = docx.segments(entries).filter("path = '/n.docx' AND seg_no = 0").orderBy("para_seq").collect()
    assert [r.para_seq for r in rows] == list(range(1, 12))
    assert [r.para_seq for r in rows if r.noted] == [2, 4, 5, 6, 7, 9, 10] and [r.feet for r in rows] == [1] + [0] * 10


def test_sections_are_the_same_without_what_segments_tell(entries):
    segments, comments, feet = settled(docx.segments(entries)), settled(docx.comments(entries)), settled(docx.footnotes(entries))
    got = {(r.path, r.section): r.text for r in S.export_sections(segments, comments, feet).collect()}
    assert got == {(r.path, r.section): r.text for r in S.export_sections(segments.drop(*TOLD), comments, feet).collect()}
    assert "Highlight: Two words\r\n" in got["/n.docx", "COMMENTS"] and "Highlight: one in a cellput intwo\r\n" in got["/n.docx", "COMMENTS"]
    assert "Anchor: Plain. \r\n" in got["/n.docx", "FOOTNOTES"] or "Anchor: Plain.\r\n" in got["/n.docx", "FOOTNOTES"]


def test_paragraphs_are_neither_ordered_nor_all_gathered(entries):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        S.document_text(S.final_paragraphs(settled(docx.segments(entries)))).explain()
    assert "Window" not in out.getvalue() and "Union" in out.getvalue()
