"""Anchors and export sections of packages made from the lines of documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from leafmark.operators import sections as S
from leafmark.plans.inputs import LINES, texts
from leafmark.plans.package_queries import FIRST, NAMES, SECOND, _change, _note, _run
from leafmark.plans.text_queries import _PLAIN
from leafmark.sources import docx
from leafmark.staging import settled


def _noted(text: str) -> bytes:
    """By line number modulo 6: a footnote (blank in every second), a heading, a list item, a table of two cells, changes by two
    reviewers, a comment. A separator stands among the footnotes."""
    body, notes, feet = [], [], ['<w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote>']
    for n, line in enumerate(text.split("\n")):
        kind = n % 6
        if kind == 0:
            body.append(f'<w:p>{_run(line)}<w:r><w:footnoteReference w:id="{n}"/></w:r></w:p>')
            feet.append(f'<w:footnote w:id="{n}"><w:p>{_run(f"note {n}" if n % 12 == 0 else " ")}</w:p></w:footnote>')
        elif kind == 1:
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading2"/><w:pPrChange/></w:pPr>{_run(line)}</w:p>')
        elif kind == 2:
            body.append(f"<w:p><w:pPr><w:numPr/></w:pPr>{_run(line)}</w:p>")
        elif kind == 3:
            body.append(f"<w:tbl><w:tr><w:tc><w:p>{_run(f'cell {n}')}</w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>")
        elif kind == 4:
            change = _change("del", 3 * n, "old", "B", SECOND) + _change("ins", 3 * n + 1, "new ", "A", FIRST) + _change("ins", 3 * n + 2, "words ", "A", FIRST)
            body.append(f"<w:p>{change}{_run(line)}</w:p>")
        else:
            body.append(f'<w:p>{_run("Before it. ")}<w:commentRangeStart w:id="{n}"/>{_run("Marked words")}<w:commentRangeEnd w:id="{n}"/>{_run(" end. Then more.")}</w:p>')
            notes.append(_note(n, "C", SECOND, f"why  {n}"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NAMES}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {NAMES}>{''.join(feet)}</w:footnotes>")
        z.writestr("word/comments.xml", f"<w:comments {NAMES}>{''.join(notes)}</w:comments>")
    return out.getvalue()


def _noted_packages(spark, sf_dir):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": [f"/in/{i}.docx" for i in pdf["doc_id"]], "content": [_noted(t) for t in pdf["text"]]})

    return texts(spark, sf_dir).mapInPandas(build, "path string, content binary")


def _tables(spark, sf_dir):
    entries = settled(_noted_packages(spark, sf_dir))
    return settled(docx.segments(entries)), docx.comments(entries), settled(docx.footnotes(entries))


def package_anchors(spark, sf_dir):
    rows, _, notes = _tables(spark, sf_dir)
    return S.anchors(rows, notes).select("path", "anchor", "type", "text")


def export_sections(spark, sf_dir):
    return S.export_sections(*_tables(spark, sf_dir))


def format_changes(spark, sf_dir):
    """Tracked changes of formatting per package."""
    return _tables(spark, sf_dir)[0].groupBy("path").agg(F.sum("format_changes").alias("format_changes"))


def comments_added(spark, sf_dir):
    """Every package gets a comment and a reply to it, behind those that it has; what a reader finds then."""
    packages = settled(_noted_packages(spark, sf_dir))
    held = docx.comment_parts(packages)
    last = F.coalesce(F.max(F.col("comment_id").cast("int")), F.lit(-1)) + 1
    notes, paras, _ = docx._comment_tables(held)
    every = packages.select("path", F.lit(None).cast("string").alias("comment_id")).unionByName(notes.select("path", "comment_id"))
    first = every.groupBy("path").agg(last.cast("string").alias("_id"))
    told = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("please <check> & reply").alias("text"), F.lit(None).cast("string").alias("parent_id")), F.struct(F.lit(2).alias("n"), F.lit("done").alias("text"), F.col("_id").alias("parent_id"))))
    new = first.select("path", told.alias("x")).select("path", "x.n", F.lit("R").alias("author"), F.lit(SECOND).alias("date"), "x.text", "x.parent_id")
    after = docx.patched(packages, docx.added_comments(held, paras, settled(docx.numbered_behind(notes, new))))
    return docx.comments(after).select("path", "comment_id", "author", "text", "parent_id")


_CLEAN = f"trim(regexp_replace(translate({_PLAIN.format('text')}, chr(13) || chr(10), '  '), ' {{2,}}', ' ', 'g'))"
_N = "chr(13) || chr(10)"
_BASE = f"""
WITH {LINES},
paras AS (
  SELECT doc_id, line_no, 0 AS half, line_no % 6 AS k, CASE line_no % 6 WHEN 3 THEN 'cell ' || line_no WHEN 4 THEN 'new words ' || line WHEN 5 THEN 'Before it. Marked words end. Then more.' ELSE line END AS text FROM lines
  UNION ALL SELECT doc_id, line_no, 1, 3, '' FROM lines WHERE line_no % 6 = 3),
p AS (SELECT '/in/' || doc_id || '.docx' AS path, *, {_CLEAN} AS clean, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, half) AS n FROM paras),
feet AS (SELECT path, clean, line_no, line_no // 6 + 1 AS n, CASE WHEN line_no % 12 = 0 THEN 'note ' || line_no ELSE ' ' END AS note FROM p WHERE k = 0),
changes AS (
  SELECT path, line_no // 6 * 2 + 1 AS n, 'old' AS text, 'Deletion' AS kind, 'B' AS author, '{SECOND}' AS date FROM p WHERE k = 4
  UNION ALL SELECT path, line_no // 6 * 2 + 2, 'new words ', 'Insertion', 'A', '{FIRST}' FROM p WHERE k = 4),
anchors AS (
  SELECT path, printf('AR_PARA_%05d', n) AS anchor, 'paragraph' AS type, text, 1 AS kind, n AS place FROM p WHERE trim(text, ' ') != ''
  UNION ALL SELECT path, 'AR_CELL_' || line_no // 6 + 1 || '_1_1', 'table_cell', text, 2, line_no FROM p WHERE k = 3 AND half = 0
  UNION ALL SELECT path, printf('AR_FN_%03d', n), 'footnote', note, 3, n FROM feet WHERE trim(note) != ''
  UNION ALL SELECT path, printf('AR_REV_%05d', n), 'other', text, 4, n FROM changes)"""


def _sql_section(name: str, body: str) -> str:
    return f"'<<{name}_START>>' || {_N} || {body} || '<<{name}_END>>' || {_N} || {_N}"


def _sql_listed(rows: str, name: str, order: str, lines: list[str], none: str) -> str:
    """A section of all documents: each row's lines, or that there are none."""
    joined = f" || {_N} || ".join(lines)
    return f"SELECT d.path, '{name}' AS section, {_sql_section(name, f'coalesce(b, {none!r}) || {_N}')} AS text FROM d LEFT JOIN (SELECT path, string_agg({joined}, {_N} ORDER BY {order}) AS b FROM {rows} GROUP BY path) x ON x.path = d.path"


_SNIP = "CASE WHEN length(clean) > 200 THEN substr(clean, 1, 200) || '...' ELSE clean END"
_SECTIONS = " UNION ALL ".join(
    [
        f"""SELECT path, 'DOCUMENT_TEXT' AS section, {_sql_section("DOCUMENT_TEXT", f"coalesce(string_agg(CASE k WHEN 1 THEN '## ' WHEN 2 THEN '- ' ELSE '' END || clean, {_N} || {_N} ORDER BY n) FILTER (clean != '') || {_N} || CASE WHEN max(n) > max(n) FILTER (clean != '') THEN {_N} ELSE '' END, '')")} AS text FROM p GROUP BY path""",
        _sql_listed(f"(SELECT *, {_CLEAN} AS clean FROM anchors WHERE kind < 4)", "BOOKMARK_INDEX", "kind, place", [f"anchor || ' | type=' || type || ' | \"' || {_SNIP} || '\"'"], "(No AR bookmarks found in document)"),
        _sql_listed("(SELECT * FROM feet WHERE clean != '' OR trim(note) != '')", "FOOTNOTES", "n", ["'## Footnote ' || n", f"'Anchor: ' || {_SNIP}", "'Text: ' || trim(note)", "'---'"], "") + " WHERE b IS NOT NULL",
        _sql_listed("(SELECT * FROM p WHERE k = 5)", "COMMENTS", "n", ["'## AR_COMMENT_' || (line_no // 6 + 1)", "'Author: C'", f"'Date: {SECOND}'", "'Scope Sentence: Marked words end.'", "'Highlight: Marked words'", "'Text: why ' || line_no", "'---'"], "(No comments in document)"),
        _sql_listed("changes", "REVISIONS", "n", ["'## AR_REV_' || printf('%05d', n)", "'Author: ' || author", "'Date: ' || date", "'Type: ' || kind", "'Text: ' || trim(text)", "'---'"], "(No revisions in document)"),
    ]
)

_ADDED = f"""
WITH {LINES}, had AS (SELECT doc_id, line_no FROM lines WHERE line_no % 6 = 5), l AS (SELECT d.doc_id, coalesce(max(line_no), -1) AS n FROM documents d LEFT JOIN had ON had.doc_id = d.doc_id GROUP BY 1)
SELECT '/in/' || doc_id || '.docx' AS path, line_no::VARCHAR AS comment_id, 'C' AS author, 'why  ' || line_no AS text, NULL AS parent_id FROM had
UNION ALL SELECT '/in/' || doc_id || '.docx', (n + 1)::VARCHAR, 'R', 'please <check> & reply', NULL FROM l
UNION ALL SELECT '/in/' || doc_id || '.docx', (n + 2)::VARCHAR, 'R', 'done', (n + 1)::VARCHAR FROM l"""

QUERIES = {
    "format_changes": (format_changes, f"WITH {LINES} SELECT '/in/' || doc_id || '.docx' AS path, count(*) FILTER (line_no % 6 = 1) AS format_changes FROM lines GROUP BY doc_id"),
    "comments_added": (comments_added, _ADDED),
    "package_anchors": (package_anchors, _BASE + " SELECT path, anchor, type, text FROM anchors"),
    "export_sections": (export_sections, _BASE + f", d AS (SELECT '/in/' || doc_id || '.docx' AS path FROM documents) {_SECTIONS}"),
}
