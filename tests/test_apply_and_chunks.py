from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from leafmark.operators import apply as Y
from leafmark.operators import chunked as C
from leafmark.operators import gates as G

LINES = "doc_id long, line_no long, line string"
PARAGRAPHS = "doc_id long, anchor string, text string, extra int"
COMMENTS = "doc_id long, ordinal long, author string, text string, anchor string"
REVISIONS = "doc_id long, anchor string, paragraph string, kind string, author string, text string"


def edit(target, kind, **more):
    return json.dumps({"bookmark_id": target, "change_type": kind} | more)


def applied(spark, lines, paragraphs, comments=(), revisions=(), **options):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    numbered = [x if isinstance(x, tuple) else (1, i, x) for i, x in enumerate(lines)]
    out = Y.apply_edits(frame(numbered, LINES), frame([(1, a, t, 0) for a, t in paragraphs], PARAGRAPHS), frame(comments, COMMENTS), frame(revisions, REVISIONS), **options)
    plan = {r.line_no: r.why or r.status for r in out.plan.collect()}
    return out, plan, {r.anchor: r.text for r in out.paragraphs.collect()}


def test_edits_of_one_paragraph_compose(spark):
    lines = [
        edit("P1", "replace_text", old_text="a", new_text="x"),
        edit("P1", "replace_text", old_text="b", new_text="y"),
        edit("P1", "replace_text", old_text="x y", new_text="z"),
        edit("P1", "replace_text", old_text="a", new_text="lost"),
        edit("P1", "replace_text", new_text="z"),
        edit("P2", "replace_text", old_text='it\'s "so"', new_text='it\'s "not so"'),
        edit("P3", "replace_text", old_text="x", new_text="see AR_PARA_00001 there"),
    ]
    out, plan, texts = applied(spark, lines, [("P1", "a b"), ("P2", "— it’s “so” —"), ("P3", "x"), ("P4", None)])
    assert texts == {"P1": "z", "P2": "— it’s “not so” —", "P3": "see there", "P4": ""}
    assert plan == {0: "Applied", 1: "Applied", 2: "Applied", 3: "OLD_TEXT_NOT_FOUND", 4: "NO_CHANGE", 5: "Applied", 6: "Applied"}
    tracked = [(r.paragraph, r.line_no, r.kind, r.text) for r in out.revisions.orderBy("line_no", "kind").collect()]
    assert tracked[:4] == [("P1", 0, "del", "a"), ("P1", 0, "ins", "x"), ("P1", 1, "del", "b"), ("P1", 1, "ins", "y")]
    assert ("P2", 5, "ins", "not ") in tracked and not [t for t in tracked if t[:3] == ("P2", 5, "del")]


def test_the_fold_equals_a_loop(spark):
    """Random edits of random texts, against edits made one after the other."""
    rng = random.Random(4)
    lines, paragraphs, want, status = [], [], {}, {}
    for p in range(40):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        anchor = f"P{p}"
        paragraphs.append((anchor, text))
        for _ in range(rng.choice([0, 1, 5, 9])):
            kind = rng.choice(["replace_text"] * 4 + ["delete_element"])
            old = "".join(rng.choice("abc ") for _ in range(rng.randrange(3)))
            new = rng.choice(["a", "bb", "c a", "abc"])
            lines.append(edit(anchor, kind, old_text=old, new_text=new))
            if kind == "delete_element":
                text, status[len(lines) - 1] = "", "Applied"
            elif old and old not in text:
                status[len(lines) - 1] = "OLD_TEXT_NOT_FOUND"
            elif (old or text) == new:
                status[len(lines) - 1] = "NO_CHANGE"
            else:
                text, status[len(lines) - 1] = (text.replace(old, new, 1) if old else new), "Applied"
        want[anchor] = text
    _, plan, texts = applied(spark, lines, paragraphs)
    assert texts == want and plan == status


def test_comments_replies_and_footnotes_have_effects(spark):
    lines = [
        edit("P1", "add_comment_only", add_comment="look AR_PARA_00002 here", confidence="h"),
        edit("AR_COMMENT_2", "reply_to_comment", add_comment="done"),
        edit("AR_COMMENT_9", "reply_to_comment", add_comment="nobody"),
        edit("AR_COMMENT_1x", "reply_to_comment", add_comment="first"),
        edit("P1", "add_footnote", new_text="note one", old_text="two"),
        edit("P1", "add_footnote", new_text="note two"),
        edit("P1", "add_footnote", new_text="none", old_text="absent"),
        edit("P1", "replace_text", old_text="one", new_text="number one", add_comment="why not"),
        edit("AR_COMMENT_1", "replace_text", new_text="x"),
        edit("P1", "add_comment_only", add_comment="AR_PARA_00001"),
    ]
    out, plan, texts = applied(spark, lines, [("P1", "one two three")], [(1, 1, "A", "a?", "P1"), (1, 2, "B", "b?", "P7")], default_confidence="low")
    assert plan == {0: "Applied", 1: "Applied", 2: "TARGET_NOT_FOUND", 3: "Applied", 4: "Applied", 5: "Applied", 6: "OLD_TEXT_NOT_FOUND", 7: "Applied", 8: "TARGET_NOT_FOUND", 9: "Applied"}
    said = [(r.ordinal, r.parent, r.text, r.anchor, r.line_no) for r in out.comments.orderBy("ordinal").collect()]
    assert said == [(1, None, "a?", "P1", None), (2, None, "b?", "P7", None), (3, None, "[AR High] look here", "P1", 0), (4, 2, "[AR Low] done", "P7", 1), (5, 1, "[AR Low] first", "P1", 3), (6, None, "[AR Low] why not", "P1", 7)]
    notes = [(r.body, texts["P1"][: r.at]) for r in out.footnotes.orderBy("line_no").collect()]
    assert notes == [("note one", "number one two"), ("note two", "number one two three")]
    bare, _, _ = applied(spark, lines[:1], [("P1", "x")], prefix=False)
    assert [r.text for r in bare.comments.collect()] == ["look here"]


def test_lines_are_shuffled_once_to_meet_their_targets(spark):
    """The shuffles of a plan whose tables are too large for broadcasts, and no join that buffers lines."""
    frames = [spark.createDataFrame([], schema) for schema in (LINES, PARAGRAPHS, COMMENTS, REVISIONS)]
    plan = Y._targets(Y._read(frames[0], True, "Medium"), *frames[1:])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "pairs" not in plan and "bookmark_id" not in plan[: plan.index("Exchange")]


def test_repeated_lines_are_told_apart(spark):
    """Of two equal lines with one number the first is applied; only the second finds its old text gone."""
    line = edit("P1", "replace_text", old_text="a", new_text="x")
    out, _, texts = applied(spark, [(1, 5, line), (1, 5, line), (2, 5, "no json"), (1, 6, None)], [("P1", "a")])
    assert sorted((r.line_no, r.why, r.text_after) for r in out.plan.collect() if r.why != "PARSE") == [(5, "", "x"), (5, "OLD_TEXT_NOT_FOUND", None)]
    assert sorted((r.doc_id, r.line_no) for r in out.plan.collect() if r.why == "PARSE") == [(1, 6), (2, 5)] and texts == {"P1": "x"}


def test_verdicts_decide_once_and_also_own_edits(spark):
    revisions = [(1, "R1", "P1", "ins", "A", "w"), (1, "R2", "P1", "del", "B", "v"), (1, "R3", "P2", "ins", "A", "u"), (2, "R1", "P1", "ins", "A", "w")]
    lines = [
        edit("P1", "accept_revision"),
        edit("R2", "accept_revision"),
        edit("P1", "replace_text", old_text="a", new_text="b"),
        edit("R1", "reject_revision"),
        edit("P2", "reject_revision"),
        edit("P2", "replace_text", old_text="c", new_text="d"),
        edit("P2", "add_footnote", new_text="gone with it"),
        edit("P3", "accept_revision"),
        edit("R9", "accept_revision"),
        edit("R3", "accept_revision", apply_change=False),
    ]
    out, plan, texts = applied(spark, lines, [("P1", "a"), ("P2", "c"), ("P3", "e")], revisions=revisions)
    got = {(r.doc_id, r.anchor or r.line_no, r.kind): (r.state, r.decided_by) for r in out.revisions.collect()}
    assert got[1, "R1", "ins"] == ("accepted", 0) and got[1, "R2", "del"] == ("accepted", 0) and got[1, "R3", "ins"] == ("rejected", 4)
    assert got[1, 2, "ins"] == got[1, 2, "del"] == ("accepted", 0) and got[1, 5, "ins"] == ("rejected", 4) and got[1, 6, "footnote"] == ("rejected", 4)
    assert got[2, "R1", "ins"] == ("pending", None)
    assert plan == {0: "Applied", 1: "NO_REVISIONS", 2: "Applied", 3: "NO_REVISIONS", 4: "Applied", 5: "Applied", 6: "Applied", 7: "NO_REVISIONS", 8: "TARGET_NOT_FOUND", 9: "APPLY_FALSE"}
    assert texts == {"P1": "b", "P2": "c", "P3": "e"} and out.footnotes.collect() == []


def test_apply_takes_empty_and_odd_tables(spark):
    out, plan, texts = applied(spark, [(1, 0, None), (1, 0, ""), (7, 0, edit("P1", "delete_element"))], [("P1", "x"), ("P1", "y")])
    assert texts == {"P1": "x"} and sorted(r.why for r in out.plan.collect()) == ["PARSE", "PARSE", "TARGET_NOT_FOUND"]
    out, plan, texts = applied(spark, [], [])
    assert plan == {} and texts == {} and out.comments.collect() == out.revisions.collect() == out.footnotes.collect() == []


# ---- chunks

HEADER = "<!-- head {++legend++} -->"


def document(sections):
    """An export of (heading, paragraphs) with a block and a run per line."""
    text, blocks = HEADER, []
    for heading, paragraphs in sections:
        for kind, line in [("heading", f"# {heading}"), *[("p", p) for p in paragraphs]]:
            start = len(text) + 2
            text += "\n\n" + line
            blocks.append((kind, start, len(text)))
    return text, blocks


def checked(spark, docs, responses, locked=()):
    exports = spark.createDataFrame([(d, text) for d, (text, _) in docs.items()], "doc_id long, exported string")
    blocks = spark.createDataFrame([(d, i, *b) for d, (_, own) in docs.items() for i, b in enumerate(own)], "doc_id long, block_seq long, kind string, md_start long, md_end long")
    runs = blocks.select("doc_id", "block_seq", F.lit(0).alias("run_index"), (F.col("md_start") + F.when(F.col("kind") == "heading", 2).otherwise(0)).alias("md_start"), "md_end", F.lit(0).alias("char_offset"))
    spans = spark.createDataFrame(list(locked), "doc_id long, s long, e long")
    given = spark.createDataFrame([(d, i, r) for (d, i), r in responses.items()], "doc_id long, chunk_index long, response string")
    return C.check(exports, blocks, given, runs, spans, spans), exports, blocks, runs, spans


def pieces(spark, docs):
    exports = spark.createDataFrame([(d, text) for d, (text, _) in docs.items()], "doc_id long, exported string")
    blocks = spark.createDataFrame([(d, i, *b) for d, (_, own) in docs.items() for i, b in enumerate(own)], "doc_id long, block_seq long, kind string, md_start long, md_end long")
    found, _ = C.split(exports, blocks)
    return {(r.doc_id, r.chunk_index): (r.base_offset, r.exported, r.header_length) for r in found.collect()}


def test_chunks_partition_the_document(spark):
    docs = {1: document([("One", ["a", "b"]), ("Two", ["c"]), ("Three", [])]), 2: document([("Only", ["x"])]), 3: (HEADER, [])}
    docs[4] = ("\n\n".join([HEADER, "## Sub", "# Top", "p"]), [("heading", 28, 34), ("heading", 36, 41), ("p", 43, 44)])
    got = pieces(spark, docs)
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)]
    assert "".join(got[1, i][1] for i in range(3)) == docs[1][0] and all(got[1, i][1].startswith("# ") for i in (1, 2))
    assert [got[k][2] for k in sorted(got)] == [len(HEADER), 0, 0, len(HEADER), len(HEADER), len(HEADER)]
    assert got[2, 0][1] == docs[2][0] and got[4, 0][1] == docs[4][0]


def test_chunked_equals_whole(spark):
    """Valid responses to random documents give the same edits and verdicts in chunks as in one piece."""
    rng = random.Random(8)
    docs, whole, parts = {}, {}, {}
    for d in range(12):
        docs[d] = document([(f"H{i}", [f"Paragraph {i}.{k} of words" for k in range(rng.randrange(3))]) for i in range(rng.randrange(1, 5))])
    for (d, i), (_, text, _) in sorted(pieces(spark, docs).items()):
        at = text.find("H") + 1
        parts[d, i] = text[:at] + rng.choice(["{++new++}", "{>>note<<}", ""]) + text[at:]
        whole[d] = whole.get(d, "") + parts[d, i]
    one, exports, blocks, runs, spans = checked(spark, docs, parts)
    responses = spark.createDataFrame([(d, r) for d, r in whole.items()], "doc_id long, response string").join(exports, "doc_id").withColumn("header_length", F.lit(len(HEADER)))
    read = G.read_responses(responses)
    other = G.verdicts(G.text_gates(read, blocks), G.anchor_gates(G.edits_of(read), runs, blocks, spans, spans))
    assert {r.doc_id: r.gate for r in one.verdicts.collect()} == {r.doc_id: r.gate for r in other.collect()} == dict.fromkeys(docs)
    columns = ["doc_id", "edit_id", "type", "md_start", "md_end", "new_text", "comment_text"]
    assert sorted(map(str, one.edits.select(*columns).collect())) == sorted(map(str, G.edits_of(read).select(*columns).collect()))


def test_the_first_bad_chunk_decides(spark):
    text = document([("One", ["aaa"]), ("Two", ["bbb"]), ("Three", ["ccc"])])
    docs = dict.fromkeys(range(1, 7), text)
    good = {i: t for (d, i), (_, t, _) in pieces(spark, {1: text}).items()}
    responses = {(d, i): t for d in docs for i, t in good.items()}
    responses[2, 1] = good[1].replace("bbb", "b{++x{--y--}++}bb")
    responses[2, 2] = good[2] + "changed"
    responses[3, 2] = good[2].replace("ccc", "cc")
    del responses[4, 1]
    responses[5, 0], responses[5, 2] = good[0].replace("aaa", "a{++x++}aa"), good[2].replace("ccc", "c{++y++}cc")
    responses[6, 0] = good[0].removeprefix(HEADER)
    responses[6, 9], responses[9, 0] = "no such chunk", "no such document"
    at = text[0].index("ccc")
    out, *_ = checked(spark, docs, responses, [(5, at, at + 3)])
    got = {r.doc_id: (r.gate, r.chunk_index, r.at, r.edit_id) for r in out.verdicts.collect()}
    assert got == {1: (None,) * 4, 2: ("G1", 1, good[1].index("bbb") + 1, None), 3: ("G2", 2, None, None), 4: ("NO_RESPONSE", 1, None, None), 5: ("G4", None, None, 1), 6: ("G2", 0, None, None)}
    assert [(r.doc_id, r.edit_id, r.chunk_index, r.md_start) for r in out.edits.orderBy("edit_id").collect()] == [(5, 0, 0, text[0].index("aaa") + 1), (5, 1, 2, at + 1)]


def test_what_is_read_of_responses_holds_no_texts(spark):
    """The gates' table is written once and read often: whole responses and exports aren't part of it."""
    rows = [(1, "# h\n\na{++b++}", "# h\n\na", 3), (2, "# h\n\nac", "# h\n\na", 3), (3, "x", "# h\n\na", 3), (4, "# h\r\n\r\na", "# h\n\na", 3)]
    read = G.read_responses(spark.createDataFrame(rows, "doc_id long, response string, exported string, header_length int"))
    assert read.columns == ["doc_id", "r", "header_kept", "text_kept"] and read.schema["r"].dataType.names == ["error", "error_at", "tokens"]
    assert {r.doc_id: (r.header_kept, r.text_kept) for r in read.collect()} == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, True)}
