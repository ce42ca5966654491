"""Accepted edits written into word-processor packages as tracked changes and comments.

Spark works out beforehand which run of which paragraph each edit cuts, between which characters and in which order; a task
then opens each changed document once, finds all paragraphs before it touches any, and cuts their runs there. Only the
elements of the body that hold those paragraphs become a tree; all other bytes of the document stay as they are, and so do
the parts that don't change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from types import SimpleNamespace
from xml.dom import minidom
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.sources import archive, docx
from leafmark.staging import settled

DOCUMENT = "word/document.xml"
#: A list marker in the text of a new paragraph.
_BULLET = re.compile(r"\A *(?:-|\d+\.)\s+")


def _kids(e, *names: str) -> list:
    return [c for c in e.childNodes if c.nodeType == c.ELEMENT_NODE and (not names or c.localName in names)]


def _runs_in(e) -> Iterator:
    for c in _kids(e, "r", "ins", "del", "hyperlink", "smartTag"):
        if c.localName == "r":
            yield c
        else:
            yield from _runs_in(c)


def _counted(p) -> Iterator:
    """The runs of a paragraph as `docx.segments` counts them."""
    for c in _kids(p, "r", "ins", "del", "hyperlink", "fldSimple", "sdt"):
        if c.localName == "r":
            yield c
        else:
            for inner in _kids(c, "sdtContent")[:1] if c.localName == "sdt" else [c]:
                yield from _runs_in(inner)


#: A tag from its first byte; attributes may hold what ends one.
_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")

_ENCODING = re.compile(rb"""\A(?:\xef\xbb\xbf)?<\?xml[^>]*?\sencoding\s*=\s*["']([^"']+)""")


class _Layout:
    """Where the elements of the body stand in the bytes of a document.xml, its outer tags, and its greatest revision number."""

    def __init__(self, content: bytes):
        self.content, self.spans, self.outer, self.last = content, [], [], 0
        self.depth, self.inside, self.parser = 0, False, expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.parser.Parse(content, True)

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        local = name.rpartition(":")[2]
        if self.depth == 2 and self.inside:
            self.spans.append((self.parser.CurrentByteIndex, -1))
        elif self.depth == 0 or self.depth == 1 and local == "body" and len(self.outer) == 1:
            self.outer.append((name, self._tag(self.parser.CurrentByteIndex)))
            self.inside = self.depth == 1
        if local in ("ins", "del"):
            number = attributes.get(f"{self.outer[0][0].rpartition(':')[0]}:id", "")
            self.last = max(self.last, int(number) if number.isdecimal() else 0)
        self.depth += 1

    def _end(self, name: str) -> None:
        self.depth -= 1
        if self.inside and self.depth == 2:
            start = self.spans[-1][0]
            empty = self._tag(start).endswith(b"/>")
            last = start if empty else self.parser.CurrentByteIndex
            self.spans[-1] = (start, last + len(self._tag(last)))
        elif self.depth == 1:
            self.inside = False

    def _tag(self, at: int) -> bytes:
        return _TAG.match(self.content, at).group()


def _layout(content: bytes) -> _Layout:
    """Places are bytes of UTF-8 without entities of its own: what is written otherwise is written anew first."""
    told = _ENCODING.match(content)
    foreign = content[:2] in (b"\xff\xfe", b"\xfe\xff") or b"<!DOCTYPE" in content or told and told[1].lower() not in (b"utf-8", b"us-ascii")
    return _Layout(minidom.parseString(content).toxml(encoding="UTF-8") if foreign else content)


class _Document:
    """The elements of one document.xml's body that change, each in a body of its own; revision numbers go on from its greatest."""

    def __init__(self, layout: _Layout, places: list[int], author: str, date: str):
        (root, root_tag), (body, body_tag) = layout.outer
        opened = lambda tag: tag[:-2] + b">" if tag.endswith(b"/>") else tag
        ended = lambda name: f"</{name}>".encode()
        bodies = [opened(body_tag) + layout.content[slice(*layout.spans[i])] + ended(body) for i in places]
        self.xml = minidom.parseString(opened(root_tag) + b"".join(bodies) + ended(root))
        self.root = self.xml.documentElement
        self.bodies = dict(zip(places, _kids(self.root)))
        self.by = {"author": author, "date": date}
        self.last = layout.last

    def element(self, name: str, *inside, **attributes: str):
        e = self.xml.createElementNS(self.root.namespaceURI, f"{self.root.prefix}:{name}")
        for key, value in attributes.items():
            e.setAttribute(f"{self.root.prefix}:{key}", value)
        for c in inside:
            e.appendChild(c)
        return e

    def change(self, kind: str, *inside):
        self.last += 1
        return self.element(kind, *inside, id=str(self.last), **self.by)

    def run(self, like, text: str, tag: str = "t"):
        said = self.element(tag, self.xml.createTextNode(text))
        said.setAttribute("xml:space", "preserve")
        return self.element("r", *[c.cloneNode(True) for c in (_kids(like, "rPr") if like else ())], said)

    def paragraph(self, place):
        e = _kids(self.bodies[place.body_idx])[0]
        if place.row_no >= 0:
            e = _kids(_kids(_kids(e, "tr")[place.row_no], "tc")[place.cell_no], "p")[place.para_no]
        if e.localName != "p":
            raise ValueError(f"the target of an edit in {place.path} is not a paragraph")
        return e

    def cut(self, run, ops: list) -> None:
        """A run in pieces, deleted ones marked, with insertions and comment marks between them in the edits' order."""
        text = "".join(n.data for t in _kids(run, "t") for n in t.childNodes)
        marks = sorted({0, len(text), *(o.at for o in ops), *(o.to for o in ops)})
        if _kids(run) != _kids(run, "rPr", "t") or marks[-1] > len(text):
            raise ValueError(f"an edit in {ops[0].path} does not fit its run")
        for a, z in zip(marks, [*marks[1:], len(text)]):
            for o in ops:
                if o.op != "del" and o.at == a:
                    for e in self.between(run, o):
                        run.parentNode.insertBefore(e, run)
            if z > a:
                gone = any(o.op == "del" and o.at <= a and z <= o.to for o in ops)
                piece = self.run(run, text[a:z], "delText" if gone else "t")
                run.parentNode.insertBefore(self.change("del", piece) if gone else piece, run)
        run.parentNode.removeChild(run)

    def between(self, run, o) -> list:
        if o.op == "ins":
            return [self.change("ins", self.run(run, o.text))]
        if o.op == "cstart":
            return [self.element("commentRangeStart", id=o.text)]
        return [self.element("commentRangeEnd", id=o.text), self.element("r", self.element("commentReference", id=o.text))]

    def marked(self, p, kind: str) -> None:
        """The paragraph's own mark as inserted or deleted, where the schema wants it."""
        props = (_kids(p, "pPr") or [p.insertBefore(self.element("pPr"), p.firstChild)])[0]
        behind = (_kids(props, "sectPr", "pPrChange") or [None])[0]
        own = (_kids(props, "rPr") or [props.insertBefore(self.element("rPr"), behind)])[0]
        own.insertBefore(self.change(kind), own.firstChild)

    def delete(self, p) -> None:
        if _kids(p, "ins", "del", "fldSimple", "sdt"):
            raise ValueError("a paragraph with tracked changes or protected text can't be deleted whole")
        for r in [r for c in _kids(p, "r", "hyperlink") for r in ([c] if c.localName == "r" else _kids(c, "r"))]:
            parent, place = r.parentNode, r.nextSibling
            for t in _kids(r, "t"):
                said = self.element("delText", *list(t.childNodes))
                said.setAttribute("xml:space", "preserve")
                r.replaceChild(said, t)
            parent.insertBefore(self.change("del", r), place)
        self.marked(p, "del")

    def added(self, p, text: str):
        """A new paragraph in the manner of p; one of its list only if the text has a list marker, which goes."""
        numbered = [n for props in _kids(p, "pPr") for n in _kids(props, "numPr")]
        bullet = _BULLET.match(text) if numbered else None
        skipped = ("sectPr", "pPrChange", "rPr") if bullet else ("sectPr", "pPrChange", "rPr", "numPr")
        props = self.element("pPr", *[c.cloneNode(True) for each in _kids(p, "pPr") for c in _kids(each) if c.localName not in skipped])
        new = self.element("p", props)
        self.marked(new, "ins")
        text = text[bullet.end() :] if bullet else text
        new.appendChild(self.change("ins", *([self.run(None, text)] if text else [])))
        return new

    def apply(self, ops: list) -> None:
        found = [(self.paragraph(own[0]), own) for own in (list(g) for _, g in groupby(ops, lambda o: (o.body_idx, o.row_no, o.cell_no, o.para_no)))]
        for p, own in found:
            runs = dict(enumerate(_counted(p)))
            for index in sorted({o.run_index for o in own if o.run_index >= 0}):
                if index not in runs or runs[index].parentNode is not p:
                    raise ValueError(f"an edit in {own[0].path} meets protected text")
                self.cut(runs[index], [o for o in own if o.run_index == index])
            behind = p.nextSibling
            for o in own:
                if o.op == "p_delete":
                    self.delete(p)
                elif o.op in ("p_before", "p_after"):
                    p.parentNode.insertBefore(self.added(p, o.text), p if o.op == "p_before" else behind)


def operations(edits: DataFrame) -> DataFrame:
    """One row per cut of the accepted edits, in order: path, place, run_index, at, to, op, text, edit_id, seq.

    edits(path, edit_id, type, new_text, comment_id, whole, targets): targets are array<struct<body_idx, row_no, cell_no,
    para_no, run_index, char_start, char_end>> in document order, one without width for a point; row_no, cell_no and para_no
    are null outside tables. whole is delete, before or after for an edit of the whole first target, else null.
    """
    first, last = F.element_at("targets", 1), F.element_at("targets", -1)
    op = lambda t, at, to, name, text, run=None: F.struct(
        t["body_idx"].cast("int").alias("body_idx"), *[F.coalesce(t[c], F.lit(-1)).cast("int").alias(c) for c in ("row_no", "cell_no", "para_no")],
        (t["run_index"] if run is None else run).cast("int").alias("run_index"), at.cast("int").alias("at"), to.cast("int").alias("to"), name.alias("op"), text.cast("string").alias("text"),
    )
    none, zero, outside = F.lit(None).cast("string"), F.lit(0), F.lit(-1)
    gone = F.transform("targets", lambda t: op(t, t["char_start"], t["char_end"], F.lit("del"), none))
    new = F.array(op(last, last["char_end"], last["char_end"], F.lit("ins"), F.col("new_text")))
    note = F.array(op(first, first["char_start"], first["char_start"], F.lit("cstart"), F.col("comment_id")), op(last, last["char_end"], last["char_end"], F.lit("cend"), F.col("comment_id")))
    whole = F.array(op(first, zero, zero, F.concat(F.lit("p_"), "whole"), F.col("new_text"), outside))
    kind = F.col("type")
    ops = F.when(F.col("whole").isNotNull(), whole).when(kind == "ins", new).when(kind == "del", gone).when(kind == "sub", F.concat(gone, new)).when(kind == "comment", note)
    return edits.select("path", "edit_id", F.posexplode(ops).alias("seq", "o")).select("path", "edit_id", "seq", "o.*")


def documents(entries: DataFrame, ops: DataFrame, author: str, date: str) -> DataFrame:
    """path, name, content of the documents that operations change. Operations on a package without a document stop the job."""

    own = entries.filter(F.col("name") == DOCUMENT).select("path", "content")
    held = _cuts(ops).join(own, "path", "left").select("path", "content", "cuts")

    def write(path: str, content: bytes | None, cuts: list[dict]) -> Iterator[dict]:
        yield {"path": path, "name": DOCUMENT, "content": _edited(path, content, cuts, author, date)}

    return docx._read(held, "path string, name string, content binary", write)


def _cuts(ops: DataFrame) -> DataFrame:
    """path and cuts: the operations on a package, paragraph by paragraph and in the edits' order."""
    order = ["body_idx", "row_no", "cell_no", "para_no", "edit_id", "seq"]
    return ops.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*order, "run_index", "at", "to", "op", "text"))).alias("cuts"))


def _edited(path: str, content: bytes | None, cuts: list[dict], author: str, date: str) -> bytes:
    """A document.xml after its cuts: the elements of the body that they meet, between bytes that stay."""
    if content is None:
        raise ValueError(f"{path} has no {DOCUMENT}")
    ops = [SimpleNamespace(path=path, **c) for c in cuts]
    layout, places = _layout(content), sorted({o.body_idx for o in ops})
    if len(layout.outer) < 2 or not 0 <= places[0] <= places[-1] < len(layout.spans):
        raise ValueError(f"the target of an edit in {path} is not a paragraph")
    document = _Document(layout, places, author, date)
    document.apply(ops)
    out, at = [], 0
    for i in places:
        start, end = layout.spans[i]
        out += [layout.content[at:start], *(e.toxml().encode() for e in document.bodies[i].childNodes)]
        at = end
    return b"".join([*out, layout.content[at:]])


def inject(entries: DataFrame, edits: DataFrame, author: str, date: str, packages: DataFrame | None = None) -> DataFrame:
    """Packages with accepted edits as tracked changes and comments: path, content; packages without edits are left out.

    With packages(path, content), whose parts the entries are, parts that don't change keep their compressed bytes. edits as for `operations`, with comment_text instead of comment_id. The same input gives the same packages.
    """
    edits = settled(edits)
    wanted = edits.select("path").distinct()
    notes = edits.filter("type = 'comment'").select("path", F.col("edit_id").alias("n"), F.lit(author).alias("author"), F.lit(date).alias("date"), F.col("comment_text").alias("text"), F.lit(None).cast("string").alias("parent_id"))
    numbers, added = None, None
    if not notes.isEmpty():  # only packages that get comments are read for theirs
        held = docx.comment_parts((entries if packages is None else packages).join(notes.select("path").distinct(), "path", "left_semi"))
        known, paras, _ = docx._comment_tables(held)
        numbered = settled(docx.numbered_behind(known, notes))
        numbers, added = numbered.select("path", F.col("n").alias("edit_id"), "comment_id"), docx.added_comments(held, paras, numbered)
    edits = edits.drop("comment_id")
    edits = edits.withColumn("comment_id", F.lit(None).cast("string")) if numbers is None else edits.join(numbers, ["path", "edit_id"], "left")
    ops = operations(edits)
    if packages is None:
        met = entries.join(wanted, "path", "left_semi")
        changed = documents(met, ops, author, date)
        return docx.rewritten(met, changed if added is None else changed.unionByName(added))
    told = wanted.join(_cuts(ops), "path", "left")
    told = told.withColumn("changes", F.lit(None).cast("array<struct<name:string,content:binary>>")) if added is None else told.join(docx.changes(added), "path", "left")
    held = told.join(packages.select("path", "content"), "path", "left").select("path", "content", "cuts", "changes")

    def write(path: str, content: bytes | None, cuts: list[dict] | None, new: list[dict] | None) -> Iterator[dict]:
        parts = docx.latest(new)
        if cuts:
            document = docx._held(content, (DOCUMENT,))[0] if content is not None else None
            parts[DOCUMENT] = _edited(path, document, cuts, author, date)
        if content is not None:
            yield {"path": path, "content": archive.patched(content, parts) if parts else content}

    return docx._read(held, "path string, content binary", write)
