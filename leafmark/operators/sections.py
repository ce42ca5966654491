"""Anchors of paragraphs, cells, footnotes and revisions, and the five text sections that an export shows them in.

Inputs are the package tables of `docx`: segments, comments and footnotes. Numbers count places in document order, so an export
and a later run over the same package give the same anchors without storing any:
  AR_PARA_00001  every paragraph counts, cells' too; blank ones get none
  AR_CELL_1_1_1  table, row and cell; blank ones get none
  AR_FN_001      footnotes by their references; blank ones get none
  AR_REV_00001   one per tracked change; neighbouring runs of one author and date are one change

Every number is a row number or rank within its package. Texts are those of the final view: insertions in, deletions out.

Defined results: packages without what a section lists have the section with a line that says so (footnotes: none); comments
without a marked range have an empty highlight; a reference to a footnote that isn't there has an empty text; null dates and
authors are empty; empty tables give no rows; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import anchor_class, clean_one_line, containing_sentence
from leafmark.sources.docx import PLACE, normalized

CRLF = "\r\n"
SNIPPET = 200


def _in_order(*more: str) -> list[Column]:
    return [F.col("body_idx"), F.col("row_no").asc_nulls_first(), F.col("cell_no").asc_nulls_first(), F.col("para_no"), *map(F.col, more)]


def _texts(c: Column, key: str, mark: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c.alias("s")))), lambda x: x["s"]), mark)


def _final() -> Column:
    """What a segment shows in the final view."""
    return F.when(F.col("t").isin("text", "ins", "opaque", "locked"), F.coalesce("text", F.lit(""))).otherwise("")


def final_paragraphs(segments: DataFrame) -> DataFrame:
    """PLACE, container, style, is_list, text (final view), para_seq (from 1)."""
    told = "para_seq" in segments.columns
    keys = [*PLACE, "container", "style", "is_list", *(["para_seq", "feet"] if told else [])]
    rows = segments.withColumn("_s", _final())
    several = rows.filter("segs > 1") if told else rows  # those of one segment are paragraphs as they stand
    paras = several.groupBy(*keys).agg(_texts(F.col("_s"), "seg_no").alias("text"))
    if told:
        return paras.unionByName(rows.filter("segs = 1").select(*keys, F.col("_s").alias("text")))
    return paras.withColumn("para_seq", F.row_number().over(Window.partitionBy("path").orderBy(*_in_order())))


def paragraph_anchors(paras: DataFrame) -> DataFrame:
    return paras.filter(F.trim("text") != "").select("path", F.format_string("AR_PARA_%05d", "para_seq").alias("anchor"), "text", F.lit(1).alias("kind"), F.col("para_seq").cast("long").alias("place"))


def cell_anchors(paras: DataFrame) -> DataFrame:
    cells = paras.filter("container = 'cell'").groupBy("path", "body_idx", "row_no", "cell_no").agg(_texts(F.col("text"), "para_no", "\r").alias("text"))
    tables = Window.partitionBy("path").orderBy("body_idx")
    told = cells.withColumn("_t", F.dense_rank().over(tables)).withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("body_idx", "row_no", "cell_no")).cast("long"))
    anchor = F.format_string("AR_CELL_%d_%d_%d", F.col("_t"), F.col("row_no") + 1, F.col("cell_no") + 1)
    return told.filter(F.trim("text") != "").select("path", anchor.alias("anchor"), "text", F.lit(2).alias("kind"), "place")


def footnote_anchors(footnotes: DataFrame) -> DataFrame:
    return footnotes.filter(F.trim("text") != "").select("path", F.format_string("AR_FN_%03d", "note_no").alias("anchor"), "text", F.lit(3).alias("kind"), F.col("note_no").cast("long").alias("place"))


def revisions(segments: DataFrame) -> DataFrame:
    """path, rev_no, kind (ins or del), author, date, text of each tracked change in order."""
    known = [c for c in ("tracked",) if c in segments.columns]
    said = F.when(F.col("t").isin("ins", "del"), F.col("text")).alias("text")  # other texts only stand between
    rows = segments.select(*PLACE, "seg_no", "t", said, "author", "date", "id", *known)
    flat = normalized(rows.filter("tracked > 0") if known else rows).filter(F.col("t").isin("ins", "del", "sub"))
    half = lambda kind, text, n: F.struct(F.lit(kind).alias("kind"), F.col(text).alias("said"), F.lit(n).alias("_half"))
    split = F.when(F.col("t") == "sub", F.array(half("del", "text", 0), half("ins", "new_text", 1))).otherwise(F.array(F.struct(F.col("t").alias("kind"), F.col("text").alias("said"), F.lit(0).alias("_half"))))
    rows = flat.withColumn("x", F.explode(split)).select(*PLACE, "seg_no", "author", "date", "x.*")
    number = F.row_number().over(Window.partitionBy("path").orderBy(*_in_order("seg_no", "_half")))
    return rows.select("path", number.cast("long").alias("rev_no"), "kind", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("date", F.lit("")).alias("date"), F.col("said").alias("text"))


def revision_anchors(changes: DataFrame) -> DataFrame:
    return changes.select("path", F.format_string("AR_REV_%05d", "rev_no").alias("anchor"), "text", F.lit(4).alias("kind"), F.col("rev_no").alias("place"))


def counted(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """The anchor of each tracked change; the job stops where a change has none, or shares it with another.

    A gap would become a verdict that is silently skipped. The check is in the column itself, so no plan that shows anchors
    leaves it out.
    """
    fault = F.raise_error(F.concat(F.lit("revision anchors and tracked changes differ in "), F.col("path")))
    own = anchors.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("path", "anchor"))).select("path", "place", "_same", F.col("anchor").alias("_anchor"))
    met = changes.select("path", F.col("rev_no").alias("place"), "text").join(own, ["path", "place"], "left")
    anchor = F.when(F.coalesce(F.col("_same") == 1, F.lit(False)), F.col("_anchor")).otherwise(fault.cast("string"))
    return met.select("path", anchor.alias("anchor"), "text", F.lit(4).alias("kind"), "place")


def anchors(segments: DataFrame, footnotes: DataFrame) -> DataFrame:
    """path, anchor, type, text of all anchors."""
    paras, changes = final_paragraphs(segments), revisions(segments)
    found = paragraph_anchors(paras).unionByName(cell_anchors(paras)).unionByName(footnote_anchors(footnotes)).unionByName(counted(revision_anchors(changes), changes))
    return found.select("path", "anchor", anchor_class(F.col("anchor")).alias("type"), "text", "kind", "place")


def _snippet(text: Column) -> Column:
    clean = clean_one_line(text)
    return F.when(F.length(clean) > SNIPPET, F.concat(F.substring(clean, 1, SNIPPET), F.lit("..."))).otherwise(clean)


def _section(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<<{name}_START>>{CRLF}"), body, F.lit(f"<<{name}_END>>{CRLF}{CRLF}"))


def _listed(rows: DataFrame, paths: DataFrame, name: str, place: str, lines: Column, none: str | None) -> DataFrame:
    """A section per path: the lines of all rows in the order of place, or a line that says that there are none."""
    body = rows.groupBy("path").agg(F.concat(_texts(F.array_join(lines, CRLF), place, CRLF), F.lit(CRLF)).alias("_b"))
    if none is None:
        return body.select("path", _section(name, F.col("_b")).alias("text"))
    return paths.join(body, "path", "left").select("path", _section(name, F.coalesce("_b", F.lit(none + CRLF))).alias("text"))


def document_text(paras: DataFrame) -> DataFrame:
    """Cleaned paragraphs with heading and list marks, a blank line between them, and one behind where blank ones end the document."""
    level = F.regexp_extract("style", r"\A[Hh]eading ?([1-4])\z", 1)
    head = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "))).when(F.col("is_list"), "- ").otherwise("")
    clean = clean_one_line(F.col("text"))
    line = F.when(clean != "", F.concat(head, clean))
    body = paras.groupBy("path").agg(_texts(line, "para_seq", CRLF + CRLF).alias("_b"), F.max(F.when(line.isNotNull(), F.col("para_seq"))).alias("_last"), F.max("para_seq").alias("_all"))
    text = F.when(F.col("_last").isNull(), "").otherwise(F.concat("_b", F.lit(CRLF), F.when(F.col("_all") > F.col("_last"), F.lit(CRLF)).otherwise("")))
    return body.select("path", _section("DOCUMENT_TEXT", text).alias("text"))


def highlights(segments: DataFrame) -> DataFrame:
    """path, comment_id, highlight and scope: what a comment's range marks, and the sentence in which it begins."""
    rows = segments.filter("noted") if "noted" in segments.columns else segments
    place = F.struct("body_idx", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("row_no", "cell_no")], "para_no", "seg_no")
    rows = rows.select(*PLACE, "seg_no", "t", "id", place.alias("_at"), _final().alias("_s"))
    before = F.sum(F.length("_s")).over(Window.partitionBy(*PLACE).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0))
    whole = rows.groupBy(*PLACE).agg(_texts(F.col("_s"), "seg_no").alias("_whole"))
    begins = rows.withColumn("_off", before).filter("t = 'cstart'").select(*PLACE, "id", "_at", "_off")
    ends = rows.filter("t = 'cend'").groupBy("path", "id").agg(F.max("_at").alias("_end"))
    r = whole.withColumnsRenamed({c: f"_r_{c}" for c in PLACE})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in PLACE]
    ranges = begins.join(ends, ["path", "id"], "left").join(r, same, "left").withColumn("_end", F.coalesce("_end", F.col("_at")))
    first = ranges.groupBy("path", "id").agg(F.min(F.struct("_at", "_end", "_off", "_whole")).alias("x")).select("path", "id", "x.*")
    inner = rows.filter("_s != ''").select(F.col("path").alias("_path"), F.col("_at").alias("_k"), "_s")
    met = first.join(inner, (F.col("path") == F.col("_path")) & (F.col("_k") > F.col("_at")) & (F.col("_k") < F.col("_end")), "left")
    marked = met.groupBy("path", "id", "_off", "_whole").agg(_texts(F.coalesce("_s", F.lit("")), "_k").alias("highlight"))
    return marked.select("path", F.col("id").alias("comment_id"), "highlight", containing_sentence(F.col("_whole"), F.col("_off").cast("int")).alias("scope"))


def export_sections(segments: DataFrame, comments: DataFrame, footnotes: DataFrame) -> DataFrame:
    """path, section, text: DOCUMENT_TEXT, BOOKMARK_INDEX, FOOTNOTES (where there are any), COMMENTS and REVISIONS."""
    paras, changes = final_paragraphs(segments), revisions(segments)
    paths = segments.select("path").distinct()
    named = lambda rows, name: rows.select("path", F.lit(name).alias("section"), "text")
    found = anchors(segments, footnotes).filter("kind < 4").withColumn("_o", F.struct("kind", "place"))
    entry = F.array(F.concat("anchor", F.lit(" | type="), "type", F.lit(' | "'), _snippet(F.col("text")), F.lit('"')))
    index = _listed(found, paths, "BOOKMARK_INDEX", "_o", entry, "(No AR bookmarks found in document)")

    referring = paras.filter("feet > 0") if "feet" in paras.columns else paras
    own = referring.select(*[F.col(c).alias(f"_r_{c}") for c in PLACE], F.col("text").alias("_para"))
    placed = footnotes.join(own, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in PLACE], "left").withColumn("_para", F.coalesce("_para", F.lit("")))
    held = placed.filter((clean_one_line(F.col("text")) != "") | (clean_one_line(F.col("_para")) != ""))
    told = F.array(F.concat(F.lit("## Footnote "), F.col("note_no").cast("string")), F.concat(F.lit("Anchor: "), _snippet(F.col("_para"))), F.concat(F.lit("Text: "), clean_one_line(F.col("text"))), F.lit("---"))
    notes = _listed(held, paths, "FOOTNOTES", "note_no", told, None)

    marked = comments.join(highlights(segments), ["path", "comment_id"], "left").withColumn("highlight", F.coalesce("highlight", F.lit(""))).withColumn("scope", F.coalesce(F.nullif("scope", F.lit("")), "highlight"))
    said = F.array(
        F.concat(F.lit("## AR_COMMENT_"), (F.col("ordinal") + 1).cast("string")), F.concat(F.lit("Author: "), F.coalesce("author", F.lit(""))), F.concat(F.lit("Date: "), F.coalesce("date", F.lit(""))),
        F.concat(F.lit("Scope Sentence: "), clean_one_line(F.col("scope"))), F.concat(F.lit("Highlight: "), clean_one_line(F.col("highlight"))), F.concat(F.lit("Text: "), clean_one_line(F.col("text"))), F.lit("---"),
    )
    remarks = _listed(marked, paths, "COMMENTS", "ordinal", said, "(No comments in document)")
    kind = F.when(F.col("kind") == "ins", "Insertion").otherwise("Deletion")
    change = F.array(F.concat(F.lit("## AR_REV_"), F.format_string("%05d", "rev_no")), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Date: "), "date"), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Text: "), clean_one_line(F.col("text"))), F.lit("---"))
    tracked = _listed(changes, paths, "REVISIONS", "rev_no", change, "(No revisions in document)")
    parts = [(document_text(paras), "DOCUMENT_TEXT"), (index, "BOOKMARK_INDEX"), (notes, "FOOTNOTES"), (remarks, "COMMENTS"), (tracked, "REVISIONS")]
    out = None
    for rows, name in parts:
        out = named(rows, name) if out is None else out.unionByName(named(rows, name))
    return out
