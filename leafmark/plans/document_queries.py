"""Packages, personas, slices, prompts and sessions over the driver's tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from leafmark.operators import passes as P
from leafmark.operators import render as N
from leafmark.plans.inputs import COMMENTS, LINES, OBSERVATIONS, comments, observations, table, texts
from leafmark.plans.review_queries import _COUNTS, _PASSES
from leafmark.sources import docx, inject, persona
from leafmark.staging import settled
from leafmark.streaming import reviews


def _package(text: str, doc_id: int) -> bytes:
    """A package with a paragraph per line; every third line is a tracked insertion, every fourth a heading."""
    body = []
    for n, line in enumerate(text.split("\n")):
        run = f'<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r>'
        inner = f'<w:ins w:id="{n}" w:author="R" w:date="2026-01-01T00:00:00Z">{run}</w:ins>' if n % 3 == 2 else run
        body.append(f"<w:p><w:pPr>{'<w:pStyle w:val=' + chr(34) + 'Heading2' + chr(34) + '/>' if n % 4 == 3 else ''}</w:pPr>{inner}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def _packages(spark, sf_dir):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": [f"/in/{i}.docx" for i in pdf["doc_id"]], "content": [_package(t, i) for t, i in zip(pdf["text"], pdf["doc_id"])]})

    return texts(spark, sf_dir).filter("length(trim(text)) > 0").mapInPandas(build, "path string, content binary")


def docx_export(spark, sf_dir):
    return docx.export(settled(_packages(spark, sf_dir))).select("path", "markdown", F.size("blocks").cast("long").alias("blocks"))


def _exported(first: str = "line", more: str = "", added: int = 0) -> str:
    """The markdown of `_packages`; first is the markup of each first line, more are rows of a document beside its lines."""
    return f"""
WITH {LINES}, k AS (SELECT *, CASE WHEN line_no % 3 = 2 THEN '{{++' || line || '++}}' WHEN line_no = 0 THEN {first} ELSE line END AS s FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(trim(text)) > 0)),
b AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 3 THEN '## ' ELSE '' END || trim(s) AS s, line_no % 4 = 3 AS kept FROM k {more}),
c AS (SELECT doc_id, count(*) FILTER (line_no % 3 = 2) + {added} AS ins FROM k GROUP BY 1)
SELECT '/in/' || b.doc_id || '.docx' AS path, '<!-- Redline export from: ' || b.doc_id || '.docx -->' || chr(10) || '<!-- ' || CASE WHEN any_value(ins) = 0 THEN 'no tracked changes or comments detected' WHEN any_value(ins) = 1 THEN '1 insertion' ELSE any_value(ins) || ' insertions' END || ' -->' || chr(10) ||
  '<!-- CriticMarkup legend: {{++ins++}} {{--del--}} {{~~old~>new~~}} {{==highlighted==}} {{>>comment<<}} -->' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY line_no) || chr(10) AS markdown, count(*) AS blocks
FROM b JOIN c ON c.doc_id = b.doc_id WHERE kept OR s != '' GROUP BY b.doc_id"""


def docx_inject(spark, sf_dir):
    """Every package gets a tracked insertion at the end of its first line and a new paragraph behind it."""
    first = F.element_at(F.split("text", "\n"), 1)
    end = F.length(first)
    at = F.array(F.struct(F.lit(0).alias("body_idx"), *[F.lit(None).cast("int").alias(c) for c in ("row_no", "cell_no", "para_no")], F.lit(0).alias("run_index"), end.alias("char_start"), end.alias("char_end")))
    rows = texts(spark, sf_dir).filter("length(trim(text)) > 0").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.lit("ins").alias("type"), F.lit(None).cast("string").alias("comment_text"), at.alias("targets"))
    edits = rows.select("*", F.lit(1).alias("edit_id"), F.lit(" [checked]").alias("new_text"), F.lit(None).cast("string").alias("whole"))
    edits = edits.unionByName(rows.select("*", F.lit(2).alias("edit_id"), F.lit("checked").alias("new_text"), F.lit("after").alias("whole")))
    packages = settled(_packages(spark, sf_dir))
    edited = inject.inject(docx.parts(packages), edits, "R", "2026-01-02T00:00:00Z", packages)
    return docx.export(settled(edited)).select("path", "markdown", F.size("blocks").cast("long").alias("blocks"))


def docx_parts(spark, sf_dir):
    return docx.parts(_packages(spark, sf_dir)).select("path", "ordinal", "name", (F.crc32("content") == F.col("crc32")).alias("sound"))


def persona_files(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("---\nname: "), "p_name", F.lit("\nnote: >-\n  a\n  b\n---\n"))).otherwise(""),
        F.lit("# "), "p_brand", F.lit("\n## Role and voice\n"), "p_type", F.lit("\n\n## Do not touch\n- one\n2. "), "p_name",
        F.when(k % 3 == 0, "\n## Style exemplars\nBefore: x\nAfter: y\n").otherwise("\n## Style exemplars\nfree text\n"),
    )
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), k.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    first = F.element_at("style_exemplars", 1)
    return persona.personas(files).select("path", "name", "role_and_voice", F.array_join("do_not_touch", "|").alias("do_not_touch"), F.coalesce(first["before"], first["raw"]).alias("exemplar"), F.size("warnings").cast("long").alias("warnings"))


PERSONAS = """SELECT '/p/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name, p_type AS role_and_voice, 'one|' || p_name AS do_not_touch, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'free text' END AS exemplar, 2 AS warnings FROM part"""


def slice_heads(spark, sf_dir):
    rows = P.passes(observations(spark, sf_dir))
    return rows.select("doc_id", "author", "pass_no", N.slice_front_matter(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("2026-01-01")).alias("head"))


HEADS = f"""
WITH {_PASSES}, g AS (SELECT doc_id, author, pass_no, min(date) AS a, max(date) AS z, {_COUNTS} FROM assigned GROUP BY ALL)
SELECT doc_id, author, pass_no, array_to_string(['---', 'doc: doc' || doc_id || '.docx', 'reviewer: ' || author, 'pass: ' || coalesce(strftime(a, '%Y-%m-%d'), 'undated'),
  'pass_window: ' || CASE WHEN a IS NULL THEN 'n/a' ELSE strftime(a, '%Y-%m-%dT%H:%MZ') || ' – ' || strftime(z, '%Y-%m-%dT%H:%MZ') END, 'edits: ' || (insertions + deletions), 'comments: ' || comments, 'replies: ' || replies, 'generated: 2026-01-01', '---'], chr(10)) AS head FROM g"""


def slice_threads(spark, sf_dir):
    notes = comments(spark, sf_dir)
    members = notes.filter("comment_id % 3 = 2").select("doc_id", (F.col("comment_id") % 2).alias("pass_no"), "comment_id")
    return N.included_comments(notes, members)


THREADS = f"""
WITH RECURSIVE {COMMENTS}, up AS (SELECT doc_id, comment_id % 2 AS pass_no, comment_id, parent_id FROM comments WHERE comment_id % 3 = 2
  UNION SELECT c.doc_id, u.pass_no, c.comment_id, c.parent_id FROM up u JOIN comments c ON c.doc_id = u.doc_id AND c.comment_id = u.parent_id)
SELECT DISTINCT doc_id, pass_no, comment_id FROM up"""


def prompt_assembly(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2).alias("chunk_index"), F.lit(2).cast("long").alias("chunks"), F.lit("h1\nh2").alias("header"), "text")
    return N.prompts(rows, F.lit("p"), F.lit("t"), F.lit("g"), F.lit("c")).select("doc_id", "prompt", "tokens")


PROMPTS = """
WITH p AS (SELECT doc_id, '[PERSONA]' || chr(10) || 'p' || chr(10) || chr(10) || '[TASK]' || chr(10) || 'This is part ' || (doc_id % 2 + 1) || ' of 2.' || chr(10) || 't' || chr(10) || chr(10) || '[GRAMMAR]' || chr(10) || 'g' || chr(10) || chr(10) || '[CONSTRAINTS]' || chr(10) || 'c' ||
  CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- Begin with these exact lines:' || chr(10) || '    h1' || chr(10) || '    h2' ELSE '' END || chr(10) || chr(10) || '[DOCUMENT]' || chr(10) || '```markdown' || chr(10) || coalesce(text, '') || chr(10) || '```' AS prompt FROM documents)
SELECT doc_id, prompt, ceil(length(prompt) / 4)::BIGINT AS tokens FROM p"""


def review_rows(spark, sf_dir):
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("edit_id")).distinct()
    saved = edits.filter("(doc_id + edit_id) % 4 = 0").select("doc_id", "edit_id", F.lit("reject").alias("decision"), F.lit(True).alias("reviewed"))
    return N.review_rows(edits, saved)


ROWS = "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS edit_id, CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'reject' ELSE 'accept' END AS decision, (l_orderkey + l_linenumber) % 4 = 0 AS reviewed FROM lineitem"


def activity_sessions(spark, sf_dir):
    return reviews.sessions(observations(spark, sf_dir))


SESSIONS = f"WITH {_PASSES} SELECT doc_id, author, min(date) AS window_start, max(date) AS window_end, {_COUNTS} FROM dated GROUP BY doc_id, author, pass_no"


def undated_activity(spark, sf_dir):
    return reviews.undated(observations(spark, sf_dir)).select("doc_id", "doc_order", "author")


QUERIES = {
    "docx_export": (docx_export, _exported()),
    "docx_inject": (docx_inject, _exported("line || '{++ [checked]++}'", "UNION ALL SELECT DISTINCT doc_id, 0.5, '{++checked++}', true FROM k", 2)),
    "docx_parts": (docx_parts, "SELECT '/in/' || doc_id || '.docx' AS path, 0 AS ordinal, 'word/document.xml' AS name, true AS sound FROM documents WHERE length(trim(text)) > 0"),
    "persona_files": (persona_files, PERSONAS),
    "slice_heads": (slice_heads, HEADS),
    "slice_threads": (slice_threads, THREADS),
    "prompt_assembly": (prompt_assembly, PROMPTS),
    "review_rows": (review_rows, ROWS),
    "activity_sessions": (activity_sessions, SESSIONS),
    "undated_activity": (undated_activity, f"WITH {OBSERVATIONS} SELECT doc_id, doc_order, CASE WHEN author = '' THEN 'Unknown' ELSE author END AS author FROM observations WHERE date IS NULL"),
}
