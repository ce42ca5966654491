"""Strict reader of one-object JSON lines, as a small character scanner inside a pandas UDF.

Spark's own JSON functions take the last of repeated keys, accept text behind the object, turn numbers into strings and
reject unknown escapes; the contract is the opposite in each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType, StructField, StructType

from leafmark.functions.text import trim_ws

# fixed values: change types, and the reason codes in the order in which they are checked
CHANGE_TYPES = ["replace_text", "delete_element", "add_comment_only", "reply_to_comment", "accept_revision", "reject_revision", "add_footnote"]
ESCAPES = {"\\": "\\", '"': '"', "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
FIELDS = ("old_text", "new_text", "add_comment", "confidence")

_WS = r"[ \t\r\n]*"
_STRING = r'"((?:[^"\\]|\\.)*)"'
_KEY = re.compile(f"{_WS}{_STRING}{_WS}:{_WS}", re.S)
_SCALAR = re.compile(f"{_STRING}|(true|false)|(null)|([-+.eE0-9]+)", re.S)
_NEXT = re.compile(f"{_WS}([,}}])")
_INSIDE = re.compile(r'[^"{}\[\]]+|' + _STRING + r"|([{\[])|([}\]])", re.S)
_ESCAPE = re.compile(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\(.)", re.S)


def _unescaped(m: re.Match) -> str:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)
    return chr(int(m[3], 16)) if m[3] else ESCAPES.get(m[4], m[4])  # an unknown escape loses its backslash


def unescape(raw: str) -> str:
    return _ESCAPE.sub(_unescaped, raw)


def _nested_end(s: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`; -1 if none does. Kinds of brackets aren't told apart."""
    depth = 0
    while m := _INSIDE.match(s, at):
        at = m.end()
        depth += bool(m[2]) - bool(m[3])
        if m[3] and depth == 0:
            return at
    return -1


def parse_object(line: str | None) -> dict[str, tuple[str, str]] | None:
    """Top-level pairs of a line as key to (type, value), types s, b, n, z and c; None for anything but one object."""
    s = (line or "").strip(" \t\r\n")
    if len(s) < 2 or s[0] != "{" or s[-1] != "}":
        return None
    if not s[1:-1].strip(" \t\r\n"):
        return {}
    pairs: dict[str, tuple[str, str]] = {}
    at = 1
    while True:
        key = _KEY.match(s, at)
        if not key:
            return None
        at = key.end()
        if s[at : at + 1] in ("{", "["):
            end = _nested_end(s, at)
            if end < 0:
                return None
            value = ("c", s[at:end])
        else:
            m = _SCALAR.match(s, at)
            if not m:
                return None
            end = m.end()
            value = ("s", unescape(m[1])) if m[1] is not None else ("b", m[2]) if m[2] else ("z", "null") if m[3] else ("n", m[4])
        pairs.setdefault(unescape(key[1]), value)  # the first of repeated keys counts
        following = _NEXT.match(s, end)
        if not following:
            return None
        at = following.end()
        if following[1] == "}":
            return pairs if at == len(s) else None


_PAIRS = MapType(StringType(), StructType([StructField("t", StringType()), StructField("v", StringType())]))


def _parse(lines: pd.Series) -> pd.Series:
    return lines.map(parse_object)


def pairs_of(line: Column) -> Column:
    """map<key, struct<t, v>>, null where the line isn't one strict object."""
    return F.pandas_udf(_parse, _PAIRS)(line)


def string_of(pairs: Column, key: str) -> Column:
    """The value under key if it is a string, else empty."""
    found = pairs[key]
    return F.when(found["t"] == "s", found["v"]).otherwise(F.lit(""))


def edit_of(pairs: Column) -> Column:
    """The seven fields of an edit line, null where the line doesn't parse as one."""
    whole = (pairs["bookmark_id"]["t"] == "s") & (pairs["change_type"]["t"] == "s")
    flag = F.when(pairs["apply_change"]["t"] == "b", pairs["apply_change"]["v"] == "true")
    fields = [string_of(pairs, k).alias(k) for k in ("bookmark_id", "change_type", *FIELDS)]
    return F.when(whole, F.struct(*fields, flag.alias("apply_change")))


_EDIT = StructType([StructField(k, StringType()) for k in ("bookmark_id", "change_type", *FIELDS)] + [StructField("apply_change", BooleanType())])


def _edit(line: str | None) -> tuple:
    pairs = parse_object(line) or {}
    kind, said = zip(*(pairs.get(f.name, ("", "")) for f in _EDIT.fields))
    if kind[0] != "s" or kind[1] != "s":
        return (None,) * len(kind)
    return (*(v if k == "s" else "" for k, v in zip(kind[:-1], said[:-1])), said[-1] == "true" if kind[-1] == "b" else None)


def _edits(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_edit(line) for line in lines], columns=_EDIT.names, dtype=object)


def edit_of_line(line: Column) -> Column:
    """`edit_of` without the map of pairs between, which costs more than the reading."""
    edit = F.pandas_udf(_edits, _EDIT)(line)
    return F.when(edit["bookmark_id"].isNotNull(), edit)


def reason_of(edit: Column) -> Column:
    """The first reason to reject an edit; empty for none, PARSE for null."""
    kind = F.lower(trim_ws(edit["change_type"]))
    on_comment = F.startswith(edit["bookmark_id"], F.lit("AR_COMMENT_"))
    blank = lambda name: trim_ws(edit[name]) == ""
    rules = [
        (edit.isNull(), "PARSE"),
        (blank("bookmark_id"), "MISSING_BOOKMARK"),
        (kind == "", "MISSING_CHANGE_TYPE"),
        (~kind.isin(CHANGE_TYPES), "UNKNOWN_CHANGE_TYPE"),
        ((kind == "replace_text") & blank("new_text"), "REPLACE_REQUIRES_NEW_TEXT"),
        ((kind == "add_comment_only") & blank("add_comment"), "COMMENT_REQUIRES_TEXT"),
        ((kind == "reply_to_comment") & ~on_comment, "REPLY_REQUIRES_COMMENT_TARGET"),
        ((kind == "reply_to_comment") & blank("add_comment"), "REPLY_REQUIRES_TEXT"),
        (kind.isin("accept_revision", "reject_revision") & on_comment, "REVISION_REQUIRES_RANGE_TARGET"),
        ((kind == "add_footnote") & on_comment, "FOOTNOTE_REQUIRES_RANGE_TARGET"),
        ((kind == "add_footnote") & blank("new_text"), "FOOTNOTE_REQUIRES_TEXT"),
    ]
    out = F.when(*rules[0])
    for rule, code in rules[1:]:
        out = out.when(rule, F.lit(code))
    return out.otherwise("")


def meta_of(pairs: Column, tag: str) -> Column:
    """session and cnt of a meta line; null where it isn't one with this tag and a plain count."""
    count = pairs["count"]["v"]
    good = (pairs["meta"]["t"] == "s") & (pairs["meta"]["v"] == tag) & (pairs["session"]["t"] == "s") & (pairs["count"]["t"] == "n") & F.rlike(count, F.lit(r"\A(?:-0{1,9}|[0-9]{1,9})\z"))
    return F.when(good, F.struct(pairs["session"]["v"].alias("session"), F.try_to_number(F.replace(count, F.lit("-"), F.lit("")), F.lit("999999999")).cast("int").alias("cnt")))


MESSAGES = {
    "PARSE": "The line is not one strict JSON object with a string bookmark_id and change_type.",
    "MISSING_BOOKMARK": "The edit names no target.",
    "MISSING_CHANGE_TYPE": "The edit names no kind of change.",
    "UNKNOWN_CHANGE_TYPE": "The kind of change is not known.",
    "REPLACE_REQUIRES_NEW_TEXT": "A replacement needs new text; use a deletion to remove text.",
    "COMMENT_REQUIRES_TEXT": "A comment needs text.",
    "REPLY_REQUIRES_COMMENT_TARGET": "A reply must target a comment.",
    "REPLY_REQUIRES_TEXT": "A reply needs text.",
    "REVISION_REQUIRES_RANGE_TARGET": "A verdict on a revision can't target a comment.",
    "FOOTNOTE_REQUIRES_TEXT": "A footnote needs its text.",
    "FOOTNOTE_REQUIRES_RANGE_TARGET": "A footnote must target text, not a comment.",
    "APPLY_FALSE": "The edit is marked as not to be applied.",
    "TARGET_NOT_FOUND": "The document has no such target.",
    "OLD_TEXT_NOT_FOUND": "The target doesn't hold the old text.",
    "NO_CHANGE": "The new text is what stands there.",
    "NO_REVISIONS": "The target holds no tracked changes.",
    "NO_EXPORT_TOKEN": "No export is recorded: export the document first.",
    "NO_PAYLOAD": "Nothing was pasted.",
    "META_MISSING": "The first line is not the meta line.",
    "TOKEN_MISMATCH": "The payload belongs to another export.",
    "COUNT_MISMATCH": "The payload holds another number of edits than it says.",
}


def message_of(code: Column) -> Column:
    """What a code means, null for an empty or unknown one."""
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[code]
