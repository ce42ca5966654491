from __future__ import annotations

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmark.sources import docx, inject, observed

NS = 'xmlns:w="urn:w" xmlns:r="urn:r" xmlns:w14="urn:w14" xmlns:w15="urn:w15" xmlns:a="urn:a" xmlns:m="urn:m"'


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def para(*inner, style="", level=None):
    props = f'<w:pStyle w:val="{style}"/>' * bool(style) + (f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>' if level is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(inner)}</w:p>"


def change(kind, text, author="Reviewer A", date="2026-07-01T09:00:00Z"):
    tag = "t" if kind == "ins" else "delText"
    return f'<w:{kind} w:id="9" w:author="{author}" w:date="{date}"><w:r><w:{tag}>{text}</w:{tag}></w:r></w:{kind}>'


def package(body, comments="", extended=None, rels=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>", zipfile.ZIP_STORED)
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr/></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        if comments:
            z.writestr("word/comments.xml", f"<w:comments {NS}>{comments}</w:comments>")
        if extended is not None:
            z.writestr("word/commentsExtended.xml", f"<w15:commentsEx {NS}>{extended}</w15:commentsEx>")
    return out.getvalue()


def note(i, author, text, pid):
    return f'<w:comment w:id="{i}" w:author="{author}" w:date="2026-07-02T10:00:00Z"><w:p w14:paraId="{pid}">{run(text)}</w:p></w:comment>'


def ranged(ids, text):
    return "".join(f'<w:commentRangeStart w:id="{i}"/>' for i in ids) + run(text) + "".join(f'<w:commentRangeEnd w:id="{i}"/>' for i in ids)


CELLS = lambda *rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"

CASES = {
    "headings": (
        package(para(run("Top"), style="Heading1") + para(run("Intro.")) + para(style="Heading2") + para(run("one"), level=0) + para(run("two"), level=1) + para() + para(run("Name"), style="Title")),
        "no tracked changes or comments detected",
        "# Top\n\nIntro.\n\n## \n\n- one\n\n  - two\n\n# Name",
    ),
    "marks": (package(para(run(" plain "), run("bold ", "<w:b/>"), run("both", "<w:b/><w:i/>"), run(" off", '<w:b w:val="0"/>'))), "no tracked changes or comments detected", "plain **bold** ***both*** off"),
    "table": (package(para(run("A table.")) + CELLS(("A", "B"), ("x|y", "")) + para(run("After."))), "no tracked changes or comments detected", "A table.\n\n| A | B |\n| --- | --- |\n| x\\|y |   |\n\nAfter."),
    "tracked": (
        package(para(run("Apply to "), change("ins", "all "), change("ins", "carriers"), run(".")) + para(run("Due in "), change("del", "30 days"), change("ins", "60 days"), run(".")) + para(change("del", "gone"), change("ins", "new", author="B"))),
        "2 insertions · 1 deletion · 1 substitution",
        "Apply to {++all carriers++}{>>—Reviewer A<<}.\n\nDue in {~~30 days~>60 days~~}{>>—Reviewer A<<}.\n\n{--gone--}{>>—Reviewer A<<}{++new++}{>>—B<<}",
    ),
    "threads": (
        package(para(ranged("01", "Discussed.")) + para(ranged("2", "Resolved.")), note(0, "A", "Right?", "P0") + note(1, "B", "Agreed.", "P1") + note(2, "B", "Cite.", "P2") + note(3, "C", "Lost.", "P3"), '<w15:commentEx w15:paraId="P1" w15:paraIdParent="P0" w15:done="0"/><w15:commentEx w15:paraId="P2" w15:done="1"/>'),
        "4 comments (3 unresolved)",
        "{=={>>B (2026-07-02): Agreed.<<}Discussed.==}{>>A (2026-07-02): Right?<<}{>>↳ B (2026-07-02): Agreed.<<}\n\n{==Resolved.==}{>>B (2026-07-02) [resolved]: Cite.<<}\n\n## Unanchored comments\n\n- {>>C (2026-07-02): Lost.<<}",
    ),
    "locked": (
        package(
            para(run("See "), f'<w:hyperlink r:id="r1">{run("link")}</w:hyperlink>', run(" and "), '<w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r>', run(" on "), '<w:fldSimple w:instr=" DATE "><w:r><w:t>1</w:t></w:r></w:fldSimple>', "<w:r><m:oMath/></w:r>")
            + f"<w:sdt><w:sdtContent>{para(run('fixed'))}</w:sdtContent></w:sdt>",
            rels='<Relationship Id="r1" Target="http://x/"/><Relationship Id="r2" Target="media/i.png"/>',
        ),
        "no tracked changes or comments detected",
        "See [link](http://x/) and [image: i.png] on ⟦field: DATE⟧⟦object⟧\n\nfixed",
    ),
}


@pytest.fixture(scope="module")
def entries(spark):
    docs = spark.createDataFrame([(f"/in/{name}.docx", content) for name, (content, _, _) in CASES.items()], "path string, content binary")
    return docx.parts(docs).persist()


def test_export_matches_expected_markdown(entries):
    got = {r.path: r for r in docx.export(entries, annotate=True).collect()}
    for name, (_, summary, body) in CASES.items():
        r = got[f"/in/{name}.docx"]
        head = f"<!-- Redline export from: {name}.docx -->\n<!-- {summary} -->\n<!-- CriticMarkup legend: {{++ins++}} {{--del--}} {{~~old~>new~~}} {{==highlighted==}} {{>>comment<<}} -->"
        assert r.markdown == f"{head}\n\n{body}\n", name
        assert "\n\n".join(r.markdown[b.md_start : b.md_end] for b in r.blocks) == body.partition("\n\n## Unanchored")[0]


def test_preflight_tells_all_reasons(entries):
    got = {r.path[4:-5]: (r.ok, r.reasons.count("\n\n")) for r in docx.preflight(docx.segments(entries), docx.comments(entries)).collect()}
    assert got["headings"] == (True, 0) and got["tracked"][0] is False and got["threads"] == (False, 1)


def test_rewriting_keeps_other_parts(spark, entries):
    changed = spark.createDataFrame([("/in/table.docx", "word/document.xml", b"<new/>"), ("/in/table.docx", "word/added.xml", b"<a/>")], "path string, name string, content binary")
    back = docx.parts(docx.rewritten(entries.filter("path = '/in/table.docx'"), changed)).orderBy("ordinal").collect()
    assert [r.name for r in back] == ["[Content_Types].xml", "word/document.xml", "word/_rels/document.xml.rels", "word/added.xml"]
    assert [bytes(r.content) for r in back][1:] == [b"<new/>", b"<Relationships></Relationships>", b"<a/>"] and back[0].method == 0


def test_comment_without_extended_part_has_no_data(spark):
    one = spark.createDataFrame([("/p.docx", package(para(ranged("0", "x")), note(0, "A", "t", "P0")))], "path string, content binary")
    assert [(r.done, r.parent_id) for r in docx.comments(docx.parts(one)).collect()] == [(None, None)]


def test_comments_are_added_with_parents(spark, entries):
    new = spark.createDataFrame([("/in/threads.docx", 1, "D & E", "2026-07-03T00:00:00Z", "cost: $5 <b> \\ \"q\"", "0"), ("/in/threads.docx", 2, "F", "2026-07-03T00:00:00Z", "again", "4"), ("/in/table.docx", 1, "G", "2026-07-03T00:00:00Z", "first", None)], "path string, n int, author string, date string, text string, parent_id string")
    changed = docx.add_comments(entries, new)
    back = {(r.path[4:-5], r.comment_id): r for r in docx.comments(docx.parts(docx.rewritten(entries, changed))).collect()}
    r = back["threads", "4"]
    assert (r.author, r.text, r.parent_id, r.done) == ("D & E", 'cost: $5 <b> \\ "q"', "0", False)
    assert back["threads", "5"].parent_id == "4" and back["threads", "1"].parent_id == "0" and back["threads", "2"].done
    assert back["table", "0"].text == "first" and back["table", "0"].parent_id is None and len(back) == 7


def test_hazards_and_format_changes(spark):
    body = f'<w:p><w:r><w:t>a</w:t><w:tab/></w:r></w:p><w:p>{run("b", "<w:rPrChange/>")}{run("c", "<w:rPrChange/>")}</w:p>'
    one = docx.parts(spark.createDataFrame([("/h.docx", package(body))], "path string, content binary"))
    assert docx.preflight(docx.segments(one), docx.comments(one)).first().reasons == "the document holds tabs, breaks or deleted text"
    assert "<!-- 2 formatting changes -->" in docx.export(one).first().markdown


def edit(i, kind, targets, new=None, note=None, whole=None):
    return ("/e.docx", i, kind, new, note, whole, [(b, None, None, None, r, s, e) for b, r, s, e in targets])


EDITS = "path string, edit_id int, type string, new_text string, comment_text string, whole string, targets array<struct<body_idx:int,row_no:int,cell_no:int,para_no:int,run_index:int,char_start:int,char_end:int>>"


@pytest.fixture(scope="module")
def editable(spark):
    body = para(run("  The "), run("quick", "<w:b/>"), run(" fox jumps")) + para(run("Heading text"), style="Heading2") + para(run("item", "<w:i/>"), level=1) + para(run("last one"))
    return docx.parts(spark.createDataFrame([("/e.docx", package(body))], "path string, content binary")).persist()


def test_runs_stand_where_they_are_shown(editable):
    shown = docx.export(editable).first().markdown
    got = [(r.block_seq, r.run_index, r.char_offset, shown[r.md_start : r.md_end]) for r in docx.runs(editable).orderBy("md_start").collect()]
    assert got == [(0, 0, 2, "The"), (0, 0, 5, " "), (0, 1, 0, "quick"), (0, 2, 0, " "), (0, 2, 1, "fox jumps"), (1, 0, 0, "Heading text"), (2, 0, 0, "item"), (3, 0, 0, "last one")]


def injected(spark, entries, *edits):
    return docx.parts(inject.inject(entries, spark.createDataFrame(list(edits), EDITS), "AR", "2026-07-05T00:00:00Z")).persist()


def test_edits_are_injected_as_tracked_changes(spark, editable):
    back = injected(
        spark, editable,
        edit(0, "sub", [(0, 0, 2, 6), (0, 1, 0, 2)], "A & "), edit(1, "ins", [(0, 2, 4, 4)], " <now>"), edit(2, "del", [(0, 2, 4, 10)]),
        edit(3, "comment", [(1, 0, 0, 7)], note="why?"), edit(4, "comment", [(3, 0, 4, 4)], note="here"),
        edit(5, "del", [(2, 0, 0, 0)], whole="delete"), edit(6, "ins", [(2, 0, 0, 0)], "- new item", whole="after"), edit(7, "ins", [(2, 0, 0, 0)], "plain", whole="after"),
    )
    shown = docx.export(back).first().markdown.split("-->\n\n", 1)[1]
    assert shown == (
        "{~~The **qu**~>**A &** ~~}**ick** fox{++ <now>++}{-- jumps--}\n\n## {==Heading==}{>>AR (2026-07-05): why?<<} text\n\n"
        "  - {--*item*--}\n\n  - {++new item++}\n\n{++plain++}\n\nlast{====}{>>AR (2026-07-05): here<<} one\n"
    )
    parts = {r.name: bytes(r.content).decode() for r in back.collect()}
    assert parts["[Content_Types].xml"].count("<Override") == 2 and parts["word/_rels/document.xml.rels"].count("<Relationship ") == 2
    ids = re.findall(r'<w:(?:ins|del) w:id="(\d+)"', parts["word/document.xml"])
    assert len(ids) == len(set(ids)) and min(map(int, ids)) == 1
    assert parts["word/document.xml"].count("<w:rPr><w:del ") == 1 and "<w:t xml:space=\"preserve\">item" not in parts["word/document.xml"]


def test_revisions_go_on_behind_those_of_the_package(spark):
    one = docx.parts(spark.createDataFrame([("/e.docx", package(para(change("ins", "x"), run("abc")) + CELLS(("k", "v"))))], "path string, content binary"))
    cell = ("/e.docx", 1, "ins", "!", None, None, [(1, 0, 1, 0, 0, 1, 1)])
    back = injected(spark, one, edit(0, "ins", [(0, 1, 3, 3)], "d"), cell)
    assert "{++x++}abc{++d++}\n\n| k | v{++!++} |" in docx.export(back).first().markdown
    document = bytes(back.filter("name = 'word/document.xml'").first().content).decode()
    assert re.findall(r'<w:ins w:id="(\d+)"', document) == ["9", "10", "11"] and 'xmlns:w14="urn:w14"' in document


@pytest.mark.parametrize(
    ("wrong", "why"),
    [
        (edit(0, "del", [(1, 0, 0, 99)]), "does not fit its run"),
        (edit(0, "del", [(1, 7, 0, 1)]), "meets protected text"),
        (edit(0, "ins", [(0, 0, 0, 0)], "x", whole="after")[:1] + (0, "del", None, None, "delete", [(4, None, None, None, 0, 0, 0)]), "is not a paragraph"),
        (("/missing.docx", *edit(0, "ins", [(0, 0, 0, 0)], "x")[1:]), "has no word/document.xml"),
    ],
)
def test_edits_that_do_not_fit_stop_the_job(spark, editable, wrong, why):
    ops = inject.operations(spark.createDataFrame([wrong], EDITS).withColumn("comment_id", F.lit(None).cast("string")))
    entries = editable.filter("path = '/e.docx'")
    with pytest.raises(Exception, match=why):
        inject.documents(entries, ops, "AR", "2026-07-05T00:00:00Z").collect()


def test_observations_and_slices(spark):
    """Replies keep the part's order beyond nine, ranges without text get a mark, lost threads come last, a pass sees its own."""
    body = para(run("One. "), ranged(["0"], "  "), run("Two."), change("del", "x"), change("ins", "y")) + para(change("ins", "z", "B", "2026-07-20T09:00:00Z"), style="Heading1")
    names = ["0", *map(str, range(2, 13)), "lost"]
    notes = "".join(note(i, "C", f"c{i}", f"P{i}") for i in names)
    more = "".join(f'<w15:commentEx w15:paraId="P{i}" ' + ('w15:paraIdParent="P0" ' if i not in ("0", "lost") else "") + 'w15:done="0"/>' for i in names)
    entries = docx.parts(spark.createDataFrame([("/in/o.docx", package(body, notes, more)), ("/in/bare.docx", package(para()))], "path string, content binary")).persist()
    seen = observed.observations(entries).orderBy("path", "doc_order").collect()
    assert [(r.doc_order, r.kind, r.text) for r in seen[:2]] == [(0, "comment", "c0"), (1, "comment-reply", "c2")] and len(seen) == 16
    assert [r.text for r in seen[1:12]] == [f"c{i}" for i in range(2, 13)] and {r.parent_comment_id for r in seen[1:12]} == {"0"}
    assert {r.anchor_text for r in seen[:12]} == {"Two."} and [(r.kind, r.text, r.id) for r in seen[12:15]] == [("deletion", "x", "9"), ("insertion", "y", "9"), ("insertion", "z", "9")]
    assert (seen[15].text, seen[15].anchor_text) == ("clost", None)
    cut = {(r.author, r.pass_no): r.slice.split("---\n\n", 1)[1] for r in observed.slices(entries, "2026-08-01").collect()}
    assert set(cut) == {("Reviewer A", 0), ("B", 0), ("C", 0)}
    # one id for all changes here, so each author's slice shows them all
    assert cut["B", 0] == "One.   Two.{~~x~>y~~}\n\n# {++z++}\n"
    assert cut["C", 0].startswith("One. {==  ==}{>>C [2026-07-02]: c0<<}{>>↳ reply to C — C [2026-07-02]: c2<<}") and cut["C", 0].endswith("Two.y\n\n# z\n") and "lost" not in cut["C", 0]


def test_large_packages_come_in_several_batches(spark):
    many = package("".join(para(run(f"p{i}")) for i in range(docx.ROWS + 10)))
    rows = docx.segments(docx.parts(spark.createDataFrame([("/many.docx", many)], "path string, content binary")))
    assert rows.count() == docx.ROWS + 10 and rows.select("body_idx").distinct().count() == docx.ROWS + 10


def test_packages_are_opened_where_they_are(spark):
    docs = spark.createDataFrame([(f"/in/{n}.docx", c[0]) for n, c in CASES.items()], "path string, content binary")
    parts = docx.parts(docs)
    for table in (docx.segments, docx.comments, docx.footnotes):
        assert sorted(table(docs).collect(), key=str) == sorted(table(parts).collect(), key=str)
    assert "Exchange" not in docx.segments(docs)._jdf.queryExecution().toString()


def cut(i, body_idx, run_index, at, op, text):
    return {"body_idx": body_idx, "row_no": -1, "cell_no": -1, "para_no": -1, "edit_id": i, "seq": 0, "run_index": run_index, "at": at, "to": at, "op": op, "text": text}


def test_only_what_an_edit_meets_is_written_anew(monkeypatch):
    """Other bytes stay, however they are written, and only the touched element becomes a tree."""
    parsed, parse = [], inject.minidom.parseString
    monkeypatch.setattr(inject.minidom, "parseString", lambda s: parsed.append(len(s)) or parse(s))
    line = "<w:p><w:r><w:t>é &amp; x</w:t></w:r></w:p>"
    head, tail = "<?xml version='1.0'?>\n<w:document xmlns:w='urn:w' w:q='a>b'><w:body> <w:p w:a='1>2'/>\n", f"<w:p/>{line * 500}<w:ins w:id='7'/><w:sectPr w:b='>'/> </w:body></w:document>\n"
    cuts = [cut(0, 1, 0, 1, "ins", "!"), cut(1, 1, -1, 0, "p_after", "new")]
    got = inject._edited("/p.docx", (head + line + tail).encode(), cuts, "A", "D").decode()
    assert got.startswith(head) and got.endswith(tail) and max(parsed) < 500
    assert re.findall(r'w:id="(\d+)"', got) == ["8", "9", "10"] and "é</w:t>" in got and '<w:t xml:space="preserve"> &amp; x</w:t>' in got
    wide = (head.replace("'1.0'", "'1.0' encoding='UTF-16'") + line + tail).encode("utf-16")
    assert '<w:ins w:id="8"' in inject._edited("/p.docx", wide, cuts, "A", "D").decode()
    with pytest.raises(ValueError, match="is not a paragraph"):
        inject._edited("/p.docx", (head + line + tail).encode(), [cut(0, 900, 0, 0, "ins", "!")], "A", "D")


def test_packages_are_edited_in_one_pass(spark):
    """Without comments no comment part is asked for, and a package meets its edits once, not part by part."""
    docs = spark.createDataFrame([(f"/{i}.docx", package(para(run("one")) + para(run("two")))) for i in range(3)], "path string, content binary")
    edits = spark.createDataFrame([("/1.docx", *edit(0, "ins", [(1, 0, 3, 3)], "!")[1:]), ("/2.docx", *edit(0, "none", [(1, 0, 3, 3)])[1:])], EDITS)
    out = inject.inject(docx.parts(docs), edits, "R", "2026-07-05T00:00:00Z", docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") == 1
    got = {r.path: bytes(r.content) for r in out.collect()}
    assert set(got) == {"/1.docx", "/2.docx"} and got["/2.docx"] == bytes(docs.filter("path = '/2.docx'").first().content)
    shown = docx.export(spark.createDataFrame([("/1.docx", got["/1.docx"])], "path string, content binary")).first().markdown
    assert shown.endswith("one\n\ntwo{++!++}\n")
    with pytest.raises(Exception, match="has no word/document.xml"):
        inject.inject(docx.parts(docs), edits.withColumn("path", F.lit("/missing.docx")), "R", "2026-07-05T00:00:00Z", docs).collect()


def test_small_parts_come_together(spark):
    fields = docx.pa.schema([("path", docx.pa.string()), ("content", docx.pa.binary())])
    rows = [{"path": str(i), "content": b"x" * n} for i, n in enumerate((10, 20, docx.BATCH_BYTES, 5, 6))]
    assert [b.num_rows for b in docx.in_batches(rows, fields)] == [3, 2]


def test_paragraphs_of_one_segment_are_not_gathered(spark):
    """They stand beside those that are put in order: marks, neighbouring changes and edges with white space."""
    body = para(run("  one ")) + para(change("ins", "a"), change("ins", "b")) + para(change("del", "c")) + para(run(" ")) + para(run("x", "<w:b/>"))
    held = docx.segments(spark.createDataFrame([("/p.docx", package(body))], "path string, content binary"))
    rows = docx.pieces(held, docx.comments(docx.parts(spark.createDataFrame([("/p.docx", package(body))], "path string, content binary"))))
    want = [("one", 2, 0, 0), ("{++ab++}", 0, 1, 0), ("{--c--}", 0, 0, 1), ("", 1, 0, 0), ("**x**", 0, 0, 0)]
    get = lambda rows: [(r.text, r.lead, r.ins, r["del"]) for r in docx.paragraphs(rows).orderBy("body_idx").collect()]
    assert get(rows) == get(rows.drop("segs")) == want
    assert sorted(map(str, docx.normalized(held).collect())) == sorted(map(str, docx.normalized(held.withColumn("tracked", F.lit(9))).withColumn("tracked", F.when(F.col("body_idx") == 1, 2).when(F.col("body_idx") == 2, 1).otherwise(0)).select(docx.normalized(held).columns).collect()))


def test_comments_are_added_from_parts_read_once(spark, entries):
    """Packages, their parts and `comment_parts` give the same, and all three tables of comments are read in one pass."""
    docs = spark.createDataFrame([(f"/in/{n}.docx", c[0]) for n, c in CASES.items()], "path string, content binary")
    new = spark.createDataFrame([("/in/threads.docx", 1, "D", "2026-07-03T00:00:00Z", "a", "0"), ("/in/threads.docx", 2, "F", "2026-07-03T00:00:00Z", "b", "4"), ("/in/table.docx", 1, "G", "2026-07-03T00:00:00Z", "c", None)], "path string, n int, author string, date string, text string, parent_id string")
    held = docx.comment_parts(docs)
    got = [sorted(map(str, docx.add_comments(x, new).collect())) for x in (entries, docs, held)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6
    notes, paras, extended = docx._comment_tables(held)
    assert notes.inputFiles() == paras.inputFiles() == extended.inputFiles() and docx.comment_parts(held) is held
    after = docx.patched(docs, docx.add_comments(held, new))
    back = {(r.path[4:-5], r.comment_id): r.parent_id for r in docx.comments(after).collect()}
    assert back["threads", "5"] == "4" and back["threads", "4"] == "0" and back["table", "0"] is None and len(back) == 7
