"""Scalar text functions of review data, as Column expressions.

Three white-space regimes occur and are never mixed: `trim_ws` (space, tab, CR, LF), single spaces, and the Unicode class
`SPACE` of web text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space of ECMAScript, and punctuation with its plain equals
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TYPOGRAPHIC = "\u2014\u2013\u2015\u2212\u2011\u201c\u201d\u2018\u2019\u00a0"
PLAIN = "-----\"\"'' "
ILLEGAL_IN_NAMES = '\\/:*?"<>|'
CHUNK_WORDS = 12000


def trim_ws(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\r\n"))


def normalize_newlines(s: Column) -> Column:
    return F.replace(s, F.lit("\r\n"), F.lit("\n"))


def normalize_punctuation(s: Column) -> Column:
    """Dashes, quotes and no-break spaces as plain characters; offsets stay."""
    return F.translate(s, TYPOGRAPHIC, PLAIN)


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(s, " {2,}", " ")


def strip_anchor_tokens(s: Column) -> Column:
    """Without anchor ids such as AR_PARA_00001, and without the double spaces that they leave."""
    return collapse_spaces(F.regexp_replace(s, "AR_[A-Za-z]+(_[A-Za-z0-9]+)+", ""))


def json_escape(s: Column) -> Column:
    """Backslash, quote, CR, LF and tab; CR and LF both become \\n."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def clean_one_line(s: Column) -> Column:
    return F.trim(collapse_spaces(F.translate(normalize_punctuation(s), "\r\n", "  ")))


def safe_file_token(s: Column) -> Column:
    """A file name's part: control characters go, illegal ones become underscores; null where nothing is left."""
    bare = F.translate(F.trim(s), "\r\n\t", "")
    return F.nullif(F.trim(F.translate(bare, ILLEGAL_IN_NAMES, "_" * len(ILLEGAL_IN_NAMES))), F.lit(""))


def file_base_name(path: Column) -> Column:
    """The last part of a backslash path without its extension, fit for a file name; `Export` where nothing is left."""
    stem = F.regexp_replace(F.substring_index(path, "\\", -1), r"(?s)\.[^.]*\z", "")
    clean = F.regexp_replace(F.translate(stem, ILLEGAL_IN_NAMES, "_" * len(ILLEGAL_IN_NAMES)), "[ .]+\\z", "")
    return F.when(clean == "", F.lit("Export")).otherwise(clean)


def working_copy_path(path: Column) -> Column:
    """path with _AR before its extension, unless it is there; empty for a path without a folder."""
    name = F.substring_index(path, "\\", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    extension = F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    return F.when(folder == "", F.lit("")).otherwise(F.concat(folder, stem, F.when(F.endswith(stem, F.lit("_AR")), F.lit("")).otherwise(F.lit("_AR")), extension))


def is_docx_name(name: Column) -> Column:
    return F.rlike(name, F.lit(r"(?i)\.docx\z"))


def document_base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.docx\z", "")


def normalize_confidence(raw: Column, default: Column) -> Column:
    level = F.lower(F.trim(default))
    fallback = F.when(level == "high", "High").when(level == "low", "Low").otherwise("Medium")
    own = F.lower(F.trim(raw))
    return F.when(own.isin("high", "h"), "High").when(own.isin("medium", "med", "m"), "Medium").when(own.isin("low", "l"), "Low").otherwise(fallback)


def split_csv(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def truthy(s: Column) -> Column:
    return F.lower(F.trim(s)).isin("yes", "y", "true", "1")


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def estimated_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("long")


def format_date(iso: Column) -> Column:
    """The date part of an ISO stamp; texts without a T inside stay."""
    return F.when(F.locate("T", iso) > 1, F.substring_index(iso, "T", 1)).otherwise(iso)


def format_window(iso: Column) -> Column:
    """An ISO stamp without its seconds."""
    return F.regexp_replace(iso, r"\A(.*T\d{2}:\d{2}):\d{2}(Z?)\z", "$1$2")


def slugify(s: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "-"), "\\A-+|-+\\z", "")
    return F.when(dashed == "", F.lit("unknown")).otherwise(dashed)


def slice_filename(document: Column, author: Column, date: Column) -> Column:
    return F.concat(slugify(document), F.lit("_"), slugify(author), F.lit("_"), F.coalesce(date, F.lit("undated")), F.lit(".md"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s")))


def excerpt(s: Column, most: int = 60) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def context(s: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The text of [start, end) with so many characters before and behind, and ellipses where it is cut."""
    a, z = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(s))
    return F.concat(F.when(a > 0, F.lit("…")).otherwise(F.lit("")), F.substring(s, (a + 1).cast("int"), (z - a).cast("int")), F.when(z < F.length(s), F.lit("…")).otherwise(F.lit("")))


def containing_sentence(s: Column, at: Column) -> Column:
    """The sentence that holds a place: from behind the last stop and white space to the next stop before one."""
    before, after = F.substring(s, F.lit(1), at.cast("int")), F.substring(s, (at + 1).cast("int"), F.length(s))
    head = F.regexp_extract(before, rf"(?s)\A(?:.*[.!?]{SPACE}+)?(.*)\z", 1)
    tail = F.regexp_extract(after, rf"(?s)\A(.*?[.!?])(?:{SPACE}|\z)", 1)
    whole = F.concat(head, F.when(F.rlike(after, F.lit(rf"(?s)[.!?](?:{SPACE}|\z)")), tail).otherwise(after))
    return F.regexp_replace(whole, rf"\A{SPACE}+|{SPACE}+\z", "")


def emphasis(s: Column, bold: Column, italic: Column) -> Column:
    """s between Markdown marks, white space at its edges outside them."""
    mark = F.concat(F.when(bold, F.lit("**")).otherwise(F.lit("")), F.when(italic, F.lit("*")).otherwise(F.lit("")))
    lead, core, trail = (F.regexp_extract(s, rf"(?s)\A({SPACE}*)(.*?)({SPACE}*)\z", i) for i in (1, 2, 3))
    plain = ~F.coalesce(bold, F.lit(False)) & ~F.coalesce(italic, F.lit(False))  # the text isn't searched where nothing marks it
    return F.when(plain, s).when(core == "", s).otherwise(F.concat(lead, mark, core, F.reverse(mark), trail))


def is_top_heading(line: Column) -> Column:
    return F.rlike(line, F.lit("\\A# (?!#)"))


def anchor_class(anchor: Column) -> Column:
    starts = lambda p: F.startswith(anchor, F.lit(p))
    return F.when(starts("AR_PARA_"), "paragraph").when(starts("AR_CELL_"), "table_cell").when(starts("AR_FN_"), "footnote").otherwise("other")


def ratified_anchor(line: Column) -> Column:
    """The id of a `[n] BOOKMARK: id` line, else null."""
    found = F.regexp_extract(trim_ws(line), r"(?si)\A\[[^\]]*\][ \t\r\n]*BOOKMARK:[ \t\r\n]*(.*)\z", 1)
    return F.nullif(trim_ws(found), F.lit(""))


def locate_normalized(needle: Column, hay: Column) -> Column:
    """0-based first place of needle under plain punctuation; null where there is none."""
    at = F.call_function("locate", normalize_punctuation(needle), normalize_punctuation(hay))
    return F.when(at > 0, at - 1)


def sha256_tag(s: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(s, 256))
