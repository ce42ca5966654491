"""Keyed tables of a review programme: configuration, personas, exemplars, audit lineage, and the optional cost formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.fingerprint import fingerprint
from leafmark.functions.jsonl import message_of
from leafmark.functions.text import normalize_confidence, sha256_tag


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes, whose non-null values win; keys are compared trimmed and in lower case."""
    norm = lambda rows: rows.withColumn("_key", F.lower(F.trim(F.col(key))))
    a, b = norm(base).alias("a"), norm(changes).alias("b")
    return a.join(b, F.col("a._key") == F.col("b._key"), "full").select(*[F.coalesce(F.col(f"a.{c}") if c == key else F.col(f"b.{c}"), F.col(f"b.{c}") if c == key else F.col(f"a.{c}")).alias(c) for c in base.columns])


def lookup(config: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(name, default) with `value`: that of the first row of config(ordinal, key, value) of this name, unless blank."""
    first = config.groupBy(F.lower(F.trim("key")).alias("_key")).agg(F.min_by("value", "ordinal").alias("value"))
    return wanted.join(first, F.lower(F.trim("name")) == F.col("_key"), "left").select("name", F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.col("default")).alias("value"))


def next_ordinals(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new(key, seq) with `ordinal`: the next free numbers behind the greatest of known(key, ordinal)."""
    last = known.groupBy(key).agg(F.max("ordinal").alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return new.withColumn("_place", place).join(last, key, "left").withColumn("ordinal", F.coalesce("_last", F.lit(0)) + F.col("_place")).drop("_place", "_last")


def present_value(rows: DataFrame, by: list[str], value: str, year: str, rate: float) -> DataFrame:
    """Present value of values by year, and the same as an equal yearly amount."""
    years = F.max(year)
    pv = F.sum(F.col(value) / F.pow(F.lit(1 + rate), F.col(year)))
    return rows.groupBy(*by).agg(pv.alias("pv"), years.alias("years")).withColumn("annualized", F.col("pv") * rate / (1 - F.pow(F.lit(1 + rate), -F.col("years"))))


def audit_record(docs: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """One JSON record per document: source and output digests and the accepted edits by type.

    docs(doc_id, source, map_hash, output): the source's digest must be that of its map; another stops the job.
    decisions(doc_id, type, decision).
    """
    accepted = decisions.filter("decision = 'accept'").groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("ins", "del", "sub", "comment")])
    own = docs.withColumn("source_sha256", sha256_tag(F.col("source"))).withColumn("output_sha256", sha256_tag(F.col("output")))
    same = F.when(F.col("source_sha256") == F.col("map_hash"), F.col("source_sha256")).otherwise(F.raise_error(F.concat(F.lit("the map belongs to another source than document "), F.col("doc_id").cast("string"))))
    counts = F.struct(*[F.coalesce(k, F.lit(0)).alias(k) for k in ("ins", "del", "sub", "comment")])
    joined = own.withColumn("source_sha256", same).join(accepted, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct(F.lit(version).alias("version"), "source_sha256", "output_sha256", counts.alias("accepted"))).alias("record"))


def burden_table(rows: DataFrame, by: str, count: str, hours: Column, wage: Column) -> DataFrame:
    """Responses, hours and cost per group with a Total row."""
    out = rows.rollup(by).agg(F.sum(count).alias("responses"), F.sum(F.col(count) * hours).alias("hours"), F.sum(F.col(count) * hours * wage).alias("cost"))
    return out.withColumn(by, F.coalesce(by, F.lit("Total")))


SESSION = "version string, state string, filename string, content string, response string, verdict string, decisions array<struct<edit_id:int,decision:string,reviewed:boolean>>"


def session_record(docs: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """One JSON session per document: docs(doc_id, state, filename, content, response, verdict), its package in base64."""
    kept = decisions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("edit_id", "decision", "reviewed"))).alias("decisions"))
    rows = docs.join(kept, "doc_id", "left").withColumn("content", F.base64("content")).withColumn("version", F.lit(version))
    return rows.select("doc_id", F.to_json(F.struct("version", "state", "filename", "content", "response", "verdict", "decisions")).alias("session"))


def resume(sessions: DataFrame, verdicts: DataFrame, version: str) -> DataFrame:
    """Sessions(doc_id, session) as columns again. verdicts(doc_id, verdict) are computed anew from content and response:
    another version, or a verdict that differs from the saved one, stops the job."""
    rows = sessions.select("doc_id", F.from_json("session", SESSION).alias("s")).select("doc_id", "s.*")
    again = verdicts.select("doc_id", F.col("verdict").alias("_again"))
    fault = lambda why: F.raise_error(F.concat(F.lit(f"{why} in the session of document "), F.col("doc_id").cast("string"))).cast("string")
    checked = F.when(~F.col("version").eqNullSafe(F.lit(version)), fault("another version")).when(~F.col("verdict").eqNullSafe(F.col("_again")), fault("another verdict")).otherwise(F.col("verdict"))
    return rows.join(again, "doc_id", "left").withColumn("verdict", checked).withColumn("content", F.unbase64("content")).drop("_again")


def line_fingerprints(lines: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of its lines(doc_id, line_no, line) in order, a line feed behind each."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    whole = F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return lines.groupBy("doc_id").agg(whole.alias("_whole")).select("doc_id", fingerprint(F.col("_whole")).alias("fingerprint"))


def attested(text: Column, told: Callable[[Column], Column] = fingerprint) -> Column:
    """An export behind a head that tells its own fingerprint."""
    return F.concat(F.lit("<<PAYLOAD_FINGERPRINT: "), told(text), F.lit(">>\r\n\r\n"), text)


def log_rows(plan: DataFrame, lines: DataFrame, edits: DataFrame, logged_at: Column, confidence: Column) -> DataFrame:
    """One row per edit line of `apply.apply_plan`: when, line, anchor, change type, status, reason, the line, confidence, pass.

    lines(doc_id, line_no, line); edits(doc_id, line_no, edit) as `edits.evaluated` reads them; confidence is the default.
    """
    rows = plan.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"]).join(edits.select("doc_id", "line_no", "edit"), ["doc_id", "line_no"])
    level = normalize_confidence(F.coalesce("edit.confidence", F.lit("")), confidence)
    reason = F.when(F.col("status") == "Skipped", F.coalesce(message_of(F.col("why")), F.nullif("why", F.lit("")), F.lit("No operation performed"))).otherwise("")
    return rows.select("doc_id", logged_at.alias("logged_at"), "line_no", F.coalesce("anchor", F.lit("")).alias("bookmark_id"), F.coalesce("edit.change_type", F.lit("")).alias("change_type"), "status", reason.alias("reason"), "line", level.alias("confidence"), "pass_no")


# fixed values: the columns of a trace row
TRACE = "Timestamp Operator Persona Mode SourceDoc WorkingDoc RecommendedRoute ExportFingerprint JsonlFingerprint LinesTotal Applied Skipped UnaddressedComments CoverageDecision WorkFolder".split()


def trace_rows(runs: DataFrame, summary: DataFrame, payloads: DataFrame) -> DataFrame:
    """The lineage row of each run, for appending: runs hold the columns of TRACE that are not counted here, and doc_id.

    summary is that of `edits.apply_summary`, payloads(doc_id, fingerprint) those of `line_fingerprints`. A run without edits
    counts none and has an empty fingerprint.
    """
    counts = summary.select("doc_id", F.col("total").alias("LinesTotal"), F.col("applied").alias("Applied"), F.col("skipped").alias("Skipped"), F.col("unaddressed").cast("string").alias("UnaddressedComments"))
    rows = runs.join(counts, "doc_id", "left").join(payloads.select("doc_id", F.col("fingerprint").alias("JsonlFingerprint")), "doc_id", "left")
    empty = {"LinesTotal": 0, "Applied": 0, "Skipped": 0, "UnaddressedComments": "", "JsonlFingerprint": ""}
    return rows.na.fill(empty).select("doc_id", *TRACE)


def read_back(runs: DataFrame, revisions: DataFrame, author: str) -> DataFrame:
    """runs(doc_id, text_edited) with `author_seen`: whether a revision in doc_id, author bears the author's name in any case;
    null where no text was edited."""
    seen = revisions.filter(F.lower("author") == author.lower()).select("doc_id", F.lit(True).alias("_seen")).distinct()
    return runs.join(seen, "doc_id", "left").select(*runs.columns, F.when(F.col("text_edited"), F.coalesce("_seen", F.lit(False))).alias("author_seen"))
