"""Review markup: the tokenizer of its five constructs, as one regular expression per construct inside a pandas UDF.

    {++inserted++}  {--deleted--}  {~~old~>new~~}  {==highlighted==}{>>comment<<}  {>>comment<<}

Tokens don't nest: an opener before the closer is an error, as is a highlight without its comment. Each token has its place
in the raw text and in the stripped text, where insertions and comments are gone and deletions stay.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_OPENER = re.compile(r"\{(?:\+\+|--|~~|==|>>)")
#: What ends each part of a construct, and every construct's parts.
_PARTS = {"{++": ["++}"], "{--": ["--}"], "{~~": ["~>", "~~}"], "{==": ["==}"], "{>>": ["<<}"]}
_KINDS = {"{++": "ins", "{--": "del", "{~~": "sub", "{==": "comment", "{>>": "comment"}

TOKEN = StructType(
    [StructField("type", StringType()), StructField("anchored", BooleanType())]
    + [StructField(n, IntegerType()) for n in ("raw_start", "raw_end", "md_start", "md_end")]
    + [StructField(n, StringType()) for n in ("old_text", "new_text", "comment_text")]
    + [StructField("whole_paragraph", BooleanType())]
)
RESULT = StructType([StructField("error", StringType()), StructField("error_at", IntegerType()), StructField("tokens", ArrayType(TOKEN)), StructField("stripped", StringType())])


class MarkupError(ValueError):
    pass


def _part(text: str, start: int, closer: str, begun: int) -> tuple[str, int]:
    """The text up to closer and the place behind it."""
    end = text.find(closer, start)
    nested = _OPENER.search(text, start, end + 2 if end >= 0 else len(text))
    if nested and (end < 0 or nested.start() < end):
        raise MarkupError(f"token opened at {begun} is not closed before another token ({nested[0]}) opens at {nested.start()}")
    if end < 0:
        raise MarkupError(f"token opened at {begun} never closes ({closer})")
    return text[start:end], end + len(closer)


def tokens_of(text: str, skip: int = 0) -> list[list]:
    """Rows of TOKEN without their whole-paragraph flag; raises MarkupError with the opener's place as second argument."""
    out, shift, at = [], 0, skip
    while m := _OPENER.search(text, at):
        begun, opener = m.start(), m[0]
        try:
            parts, end = [], m.end()
            for closer in _PARTS[opener]:
                part, end = _part(text, end, closer, begun)
                parts.append(part)
            comment = None
            if opener == "{==":
                if not text.startswith("{>>", end):
                    raise MarkupError("{==...==} must be immediately followed by {>>...<<}")
                comment, end = _part(text, end + 3, "<<}", begun)
            elif opener == "{>>":
                comment, parts = parts[0], [""]
        except MarkupError as e:
            raise MarkupError(str(e), begun) from None
        old = "" if opener == "{++" else parts[0]
        new = parts[-1] if opener in ("{++", "{~~") else None
        start = begun - shift
        out.append([_KINDS[opener], opener == "{==", begun, end, start, start + len(old), old, new, comment, False])
        shift += end - begun - len(old)
        at = end
    return out


def _mark_whole(text: str, rows: list[list]) -> None:
    """Flags insertions and deletions that stand alone on their line; tokens that touch are looked through."""
    for i, t in enumerate(rows):
        if t[0] not in ("ins", "del"):
            continue
        a, j = t[2], i
        while text[text.rfind("\n", 0, a) + 1 : a].strip() and j and rows[j - 1][3] == a:
            j -= 1
            a = rows[j][2]
        z, k = t[3], i
        line = lambda z: text[z : len(text) if (n := text.find("\n", z)) < 0 else n]
        while line(z).strip() and k + 1 < len(rows) and rows[k + 1][2] == z:
            k += 1
            z = rows[k][3]
        t[9] = not text[text.rfind("\n", 0, a) + 1 : a].strip() and not line(z).strip()


def read(text: str | None, skip: int = 0) -> tuple:
    """A row of RESULT."""
    text = text or ""
    try:
        rows = tokens_of(text, skip)
    except MarkupError as e:
        return e.args[0], e.args[1], None, None
    _mark_whole(text, rows)
    parts, at = [], 0
    for t in rows:
        parts += [text[at : t[2]], t[6]]
        at = t[3]
    return None, None, [tuple(t) for t in rows], "".join(parts) + text[at:]


def _read(texts: pd.Series, skips: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(t, 0 if pd.isna(s) else int(s)) for t, s in zip(texts, skips)], columns=RESULT.names)


def tokenized(text: Column, skip: Column | None = None) -> Column:
    """error, error_at, tokens and stripped; the first `skip` characters hold no tokens."""
    return F.pandas_udf(_read, RESULT)(text, F.lit(0) if skip is None else skip)


def fences(text: Column) -> Column:
    """The contents of all closed code fences, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)


def candidates(text: Column, exported_length: Column) -> Column:
    """What may be the whole document in a paste: fences of at least half its length, the last first; without fences, all."""
    found = fences(text)
    large = F.reverse(F.filter(found, lambda c: F.length(c) >= exported_length * 0.5))
    return F.when(F.size(found) == 0, F.array(text)).otherwise(large)
