"""Structured answers to labelled comments and changes: parsed, checked, and applied at most once.

A line answers one label: `[C3] reply: text | recommend: resolve` a comment, `[R7] recommend: accept | rationale: text` a tracked
change. lines(doc_id, payload_no, line_no, line); targets(doc_id, label); addressed(doc_id, label): what earlier runs applied.

Checks come in order, and the first that fails is the line's code. Of the sound lines of a label the first by payload and line
is applied, unless the label was addressed before; `Answered.addressed` added to what was addressed makes the same payload, or a
later one, change nothing. The first line of a label comes from a minimum, not from a window over its lines.

Defined results: null and blank lines are left out; labels are compared without leading zeros; repeated targets are one; lines
that repeat payload and line number are ordered by the line; empty tables give empty tables; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.staging import settled

# fixed values: what a label of each kind may say, and the recommendations
FIELDS = {"C": ("reply", "recommend"), "R": ("recommend", "rationale")}
RECOMMENDATIONS = {"C": ("resolve", "keep"), "R": ("accept", "reject")}
MOST_CHARS = 2000


@dataclass(frozen=True)
class Answered:
    """plan: doc_id, payload_no, line_no, label, reply, recommend, rationale, code (empty: applied).

    comments: doc_id, label, text, threaded: replies under the comment, and recommendations on changes as comments beside them.
    resolved: doc_id, label of the comments to be resolved. addressed: doc_id, label.
    """

    plan: DataFrame
    comments: DataFrame
    resolved: DataFrame
    addressed: DataFrame


def parsed(lines: DataFrame) -> DataFrame:
    """lines with kind, label, fields (map), and doubled: whether a field is given twice or not named."""
    text = F.trim(F.regexp_replace("line", r"[\t\r\n]+", " "))
    shape = r"^\[([CR])0*([0-9]{1,9})\] *(.*)$"
    kind, number, rest = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    parts = F.transform(F.split(rest, r" *\| *(?=[A-Za-z]+ *:)"), lambda p: F.trim(p))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))
    rows = lines.filter(text != "").withColumn("kind", kind).withColumn("label", F.when(kind != "", F.concat(kind, number))).withColumn("_parts", F.transform(parts, lambda p: F.contains(p, F.lit(":")))).withColumn("_pairs", pairs)
    names = F.transform("_pairs", lambda p: p["k"])
    doubled = F.exists("_parts", lambda x: ~x) | (F.size(F.array_distinct(names)) < F.size(names))
    value = lambda name: F.filter("_pairs", lambda p: p["k"] == name)
    return rows.withColumn("doubled", doubled).withColumn("names", names).select("*", *[F.get(value(n), F.lit(0))["v"].alias(n) for n in ("reply", "recommend", "rationale")]).drop("_parts", "_pairs")


def _code(known: Column, most: int) -> Column:
    kind = F.col("kind")
    allowed = F.when(kind == "C", F.array(*map(F.lit, FIELDS["C"]))).otherwise(F.array(*map(F.lit, FIELDS["R"])))
    said = F.lower("recommend")
    good = F.when(kind == "C", said.isin(*RECOMMENDATIONS["C"])).otherwise(said.isin(*RECOMMENDATIONS["R"]))
    longest = F.greatest(*[F.coalesce(F.length(n), F.lit(0)) for n in ("reply", "rationale")])
    return (
        F.when((kind == "") | F.col("doubled"), "MALFORMED")
        .when(~known, "UNKNOWN_LABEL")
        .when(F.size(F.array_except("names", allowed)) > 0, "FIELD_NOT_ALLOWED")
        .when(F.col("recommend").isNotNull() & ~good, "UNKNOWN_RECOMMENDATION")
        .when((kind == "R") & F.col("recommend").isNull(), "RECOMMENDATION_MISSING")
        .when((kind == "C") & (F.coalesce("reply", F.lit("")) == "") & F.col("recommend").isNull(), "NOTHING_SAID")
        .when(longest > most, "TOO_LONG")
        .otherwise("")
    )


def checked(lines: DataFrame, targets: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """Each line read and checked by itself, once for all that is asked of it: code is empty where it is sound."""
    known = targets.select("doc_id", "label").distinct().withColumn("_known", F.lit(True))
    rows = parsed(lines).join(known, ["doc_id", "label"], "left").withColumn("code", _code(F.coalesce("_known", F.lit(False)), most_chars))
    return settled(rows.select("doc_id", "payload_no", "line_no", "line", "label", "reply", "recommend", "rationale", "code"))


def answer(lines: DataFrame, targets: DataFrame, addressed: DataFrame | None = None, most_chars: int = MOST_CHARS) -> Answered:
    """What becomes of each line, and what the sound ones do."""
    return answered(checked(lines, targets, most_chars), addressed)


def answered(rows: DataFrame, addressed: DataFrame | None = None) -> Answered:
    """`answer` for rows of `checked`, which serve several runs."""
    place = F.struct("payload_no", "line_no", "line")
    first = rows.filter("code = ''").groupBy("doc_id", "label").agg(F.min(place).alias("_first"))
    if addressed is not None:
        first = first.join(addressed.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
    applied = first.select("doc_id", "label")
    rows = rows.join(first, ["doc_id", "label"], "left").withColumn("code", F.when((F.col("code") == "") & ~F.coalesce(place == F.col("_first"), F.lit(False)), "ALREADY_ADDRESSED").otherwise(F.col("code")))
    plan = rows.select("doc_id", "payload_no", "line_no", F.coalesce("label", F.lit("")).alias("label"), "reply", F.lower("recommend").alias("recommend"), "rationale", "code")
    going = plan.filter("code = ''").dropDuplicates(["doc_id", "label"])
    told = F.when(F.startswith("label", F.lit("C")), F.col("reply")).otherwise(F.concat(F.lit("Recommended: "), "recommend", F.coalesce(F.concat(F.lit(" — "), F.nullif("rationale", F.lit(""))), F.lit(""))))
    return Answered(
        plan=plan,
        comments=going.select("doc_id", "label", told.alias("text"), F.startswith("label", F.lit("C")).alias("threaded")).filter("text != ''"),
        resolved=going.filter("recommend = 'resolve'").select("doc_id", "label"),
        addressed=applied,
    )
