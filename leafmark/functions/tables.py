"""Table functions for SQL: markup tokens and edit lines with LATERAL, payload lines by PARTITION BY.

    SELECT doc_id, t.* FROM docs, LATERAL markup_tokens(text) t
    SELECT doc_id, line_no, e.* FROM lines, LATERAL edit_line(line) e
    SELECT * FROM payload_lines(TABLE(SELECT doc_id, line_no, line FROM lines) PARTITION BY doc_id ORDER BY line_no)

They call the same scanners as the column functions. Null texts have no tokens, null lines don't parse; a text that breaks the
grammar gives one row with its error. `payload_lines` holds a document's lines until its first fence, then one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from leafmark.functions import jsonl, markup

TOKEN = "edit_id int, type string, anchored boolean, raw_start int, raw_end int, md_start int, md_end int, old_text string, new_text string, comment_text string, whole_paragraph boolean, error string, error_at int"
EDIT = "bookmark_id string, change_type string, old_text string, new_text string, add_comment string, confidence string, apply_change boolean, parsed boolean"
LINE = "doc_id long, line_no long, line string"
WHITE = " \t\r\n"


class MarkupTokens:
    def eval(self, text: str) -> Iterator[tuple]:
        error, at, rows, _ = markup.read(text)
        if error is not None:
            yield (*[None] * 11, error, at)
        for i, row in enumerate(rows or ()):
            yield (i, *row, None, None)


class EditLine:
    def eval(self, line: str) -> Iterator[tuple]:
        pairs = jsonl.parse_object(line) or {}
        said = lambda key: pairs[key][1] if pairs.get(key, "?")[0] == "s" else ""
        if any(pairs.get(k, "?")[0] != "s" for k in ("bookmark_id", "change_type")):
            yield (*[None] * 7, False)
            return
        flag = pairs["apply_change"][1] == "true" if pairs.get("apply_change", "?")[0] == "b" else None
        yield (said("bookmark_id"), said("change_type"), *(said(k) for k in jsonl.FIELDS), flag, True)


class PayloadLines:
    """Lines between the first fence and the next; all but the blank ones where there is no fence."""

    def __init__(self) -> None:
        self.fences, self.held = 0, []

    def eval(self, row: Row) -> Iterator[tuple]:
        line = (row["line"] or "").strip(WHITE)
        if line.startswith("```"):
            self.fences, self.held = self.fences + 1, []
        elif self.fences == 0 and line:
            self.held.append((row["doc_id"], row["line_no"], line))
        elif self.fences == 1 and line:
            yield row["doc_id"], row["line_no"], line

    def terminate(self) -> Iterator[tuple]:
        yield from self.held


def register(spark: SparkSession) -> None:
    """The table functions under their SQL names."""
    for name, made, schema in (("markup_tokens", MarkupTokens, TOKEN), ("edit_line", EditLine, EDIT), ("payload_lines", PayloadLines, LINE)):
        spark.udtf.register(name, udtf(made, returnType=schema))
