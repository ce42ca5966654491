"""Applying edit lines to a document: an ordered fold over each target's text, and the tables that it changes.

lines(doc_id, line_no, line); paragraphs(doc_id, anchor, text), which may be paragraphs, cells or notes; comments(doc_id,
ordinal, author, text, anchor); revisions(doc_id, anchor, paragraph, kind, author, text), pending changes by others.

There are two passes. The first takes replacements, deletions, comments, replies and footnotes in the order of lines, each on
the text that the line before it left; the second takes verdicts on revisions. Edits of text are themselves tracked, so a
verdict on a paragraph also decides the edits of the first pass there; rejecting takes the paragraph back to its text before.

The checks of a line come in order: parse, apply_change false, validation, target, operation. One anchor's lines are folded in
one row, since each needs what the one before left; what the fold keeps per line are the pieces cut out and put in, never
the text. Everything else is joins on (doc_id, anchor). Verdicts are first reduced to the first per anchor, which leaves
nothing for later ones, so an anchor with many verdicts and many revisions makes no pairs.

Defined results: null texts of paragraphs are empty; a target that is there twice is one (its smallest text); repeated line
numbers are ordered by the line; null lines don't parse; without comments or revisions (None) targets of that kind aren't
checked and change nothing; empty tables give empty tables; further columns of the tables are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import normalize_confidence, normalize_punctuation, strip_anchor_tokens, trim_ws
from leafmark.operators.edits import bound, evaluated, minimal_span
from leafmark.staging import settled

TEXT_KINDS = ("replace_text", "delete_element", "add_footnote")
VERDICTS = ("accept_revision", "reject_revision")
COMMENT = "AR_COMMENT_"
AUTHOR = "reviewing tool"

_DONE = "array<struct<line_no:bigint,why:string,start:int,deleted:string,inserted:string,shown:string>>"
_NOTES = "array<struct<line_no:bigint,at:int,body:string>>"


@dataclass(frozen=True)
class Applied:
    """plan: doc_id, line_no, pass_no, status, why, anchor, text_after. The others are the tables behind all lines.

    paragraphs: doc_id, anchor, text. comments: doc_id, ordinal, parent, author, text, anchor, line_no (null: was there).
    revisions: doc_id, anchor, paragraph, kind, author, text, line_no (null: was there), state, decided_by.
    footnotes: doc_id, anchor, at (place in the paragraph's text), body, line_no.
    """

    plan: DataFrame
    paragraphs: DataFrame
    comments: DataFrame
    revisions: DataFrame
    footnotes: DataFrame


def _step(state: Column, edit: Column) -> Column:
    """The text, what was done and where footnotes stand behind one more edit."""
    text, old, kind = state["text"], edit["old"], edit["kind"]
    found = F.when(old == "", F.lit(1)).otherwise(F.call_function("locate", normalize_punctuation(old), normalize_punctuation(text)))
    nothing = F.lit("")

    def told(why: Column, start: Column, deleted: Column, inserted: Column) -> Column:
        return F.struct(why.alias("why"), start.cast("int").alias("start"), deleted.alias("deleted"), inserted.alias("inserted"))

    def replaced(at: Column) -> Column:
        scope = F.when(old == "", text).otherwise(F.substring(text, at, F.length(old)))

        def narrowed(t: Column) -> Column:
            middle = F.substring(t["scope"], t["s"]["prefix"] + 1, F.length(t["scope"]) - t["s"]["prefix"] - t["s"]["suffix"])
            return F.when(t["s"].isNull(), told(F.lit("NO_CHANGE"), F.lit(0), nothing, nothing)).otherwise(told(nothing, at - 1 + t["s"]["prefix"], middle, t["s"]["middle"]))

        return bound(scope, lambda s: bound(F.struct(s.alias("scope"), minimal_span(s, edit["new"]).alias("s")), narrowed))

    def change(at: Column) -> Column:
        behind = F.when(old == "", F.length(text)).otherwise(at - 1 + F.length(old))
        return (
            F.when(kind == "delete_element", told(nothing, F.lit(0), text, nothing))
            .when(at == 0, told(F.lit("OLD_TEXT_NOT_FOUND"), F.lit(0), nothing, nothing))
            .when(kind == "add_footnote", told(nothing, behind, nothing, nothing))
            .otherwise(replaced(at))
        )

    def moved(c: Column) -> Column:
        end, gain = c["start"] + F.length(c["deleted"]), F.length(c["inserted"]) - F.length(c["deleted"])
        notes = F.transform(state["notes"], lambda n: F.struct(n["line_no"].alias("line_no"), F.when(n["at"] >= end, n["at"] + gain).when(n["at"] > c["start"], c["start"] + F.length(c["inserted"])).otherwise(n["at"]).alias("at"), n["body"].alias("body")))
        note = F.array(F.struct(edit["line_no"].alias("line_no"), c["start"].alias("at"), edit["new"].alias("body")))
        is_note = (kind == "add_footnote") & (c["why"] == "")
        after = F.concat(F.substring(text, F.lit(1), c["start"]), c["inserted"], F.substring(text, end + 1, F.length(text)))
        done = F.struct(edit["line_no"].alias("line_no"), *[c[x].alias(x) for x in ("why", "start", "deleted", "inserted")], edit["shown"].alias("shown"))
        return F.struct(
            F.when(c["why"] == "", after).otherwise(text).alias("text"),
            F.concat(state["done"], F.array(done)).alias("done"),
            F.when(is_note, F.concat(state["notes"], note)).when(c["why"] == "", notes).otherwise(state["notes"]).alias("notes"),
        )

    return bound(found, lambda at: bound(change(at), moved))


def folded(edits: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """paragraphs with text behind all of edits(doc_id, anchor, line_no, line, kind, old, new, shown), and done, notes (null: no edits)."""
    steps = F.array_sort(F.collect_list(F.struct("line_no", "line", "kind", "old", "new", "shown")))
    gathered = edits.groupBy("doc_id", "anchor").agg(steps.alias("steps"))
    start = F.struct(F.col("text").alias("text"), F.array().cast(_DONE).alias("done"), F.array().cast(_NOTES).alias("notes"))
    met = paragraphs.join(gathered, ["doc_id", "anchor"], "left").withColumn("f", F.when(F.col("steps").isNotNull(), F.aggregate("steps", start, _step)))
    return met.select("doc_id", "anchor", F.col("text").alias("text_before"), F.coalesce("f.text", "text").alias("text"), F.col("f.done").alias("done"), F.col("f.notes").alias("notes"))


def _unique(rows: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_v")).select(*keys, *[F.col("_v")[c].alias(c) for c in others])


def _read(lines: DataFrame, prefix: bool, default_confidence: str) -> DataFrame:
    """Each line's target, kind, pass, the reason to stop before the target is looked for, and what applying it will take."""
    rows = evaluated(lines.select("doc_id", "line_no", "line")).withColumn("kind", F.lower(trim_ws(F.col("edit.change_type")))).withColumn("anchor", trim_ws(F.col("edit.bookmark_id")))
    ordinal = F.try_to_number(F.nullif(F.regexp_extract("anchor", rf"^{COMMENT}([0-9]{{1,9}})", 1), F.lit("")), F.lit("999999999")).cast("long")
    why = F.when(F.col("reason") == "PARSE", "PARSE").when(~F.coalesce("edit.apply_change", F.lit(True)), "APPLY_FALSE").otherwise(F.col("reason"))
    second = F.coalesce(F.col("kind").isin(*VERDICTS) & (F.col("reason") == ""), F.lit(False))
    going, folds = why == "", F.coalesce(F.col("kind").isin(*TEXT_KINDS), F.lit(False))
    new = F.when(F.col("kind") == "delete_element", F.lit("")).otherwise(strip_anchor_tokens(F.col("edit.new_text")))
    level = normalize_confidence(F.col("edit.confidence"), F.lit(default_confidence))
    body = strip_anchor_tokens(F.col("edit.add_comment"))
    speaks = (F.trim(body) != "") & F.col("kind").isin("replace_text", "delete_element", "add_comment_only", "reply_to_comment")
    shown = F.concat(F.lit("[AR "), level, F.lit("] "), body) if prefix else body
    own = {"line": (folds, F.col("line")), "old": (folds, F.col("edit.old_text")), "new": (folds, new), "shown": (speaks, shown)}
    taken = [F.when(going & needed, value).alias(name) for name, (needed, value) in own.items()]
    return rows.select("doc_id", "line_no", "anchor", "kind", F.when(F.startswith("anchor", F.lit(COMMENT)), ordinal).alias("ordinal"), why.alias("why"), F.when(second, 2).otherwise(1).alias("pass_no"), folds.alias("folds"), *taken)


def _targets(rows: DataFrame, paragraphs: DataFrame, comments: DataFrame | None, revisions: DataFrame | None) -> DataFrame:
    """rows of `_read` with the reason why they go no further than their target, and the scope of comments that they answer.

    Lines meet all that they may aim at under one key, in one shuffle: what is there comes before the lines of its key.
    """
    on_comment = F.startswith("anchor", F.lit(COMMENT))
    of_comment = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    of_text = lambda c: F.concat(F.lit("t"), F.col(c))
    yes, no, none = F.lit(True), F.lit(None).cast("boolean"), F.lit(None).cast("string")
    flags = lambda text, revision, comment, scope: [text.alias("_text"), revision.alias("_revision"), comment.alias("_comment"), scope.alias("scope")]
    known = paragraphs.select("doc_id", of_text("anchor").alias("_key"), *flags(yes, no, no, none))
    if comments is not None:
        known = known.unionByName(comments.select("doc_id", of_comment("ordinal").alias("_key"), *flags(no, no, yes, F.col("anchor"))))
    if revisions is not None:
        known = known.unionByName(revisions.select("doc_id", of_text("anchor").alias("_key"), *flags(no, yes, no, none)))
    known = known.filter("doc_id is not null and _key is not null").withColumn("_aims", F.lit(False))
    both = rows.withColumn("_key", F.when(on_comment, of_comment("ordinal")).otherwise(of_text("anchor"))).withColumn("_aims", F.lit(True)).unionByName(known, allowMissingColumns=True)
    met = Window.partitionBy("doc_id", "_key").orderBy("_aims").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({c: F.max(c).over(met) for c in ("_text", "_revision", "_comment", "scope")}).filter("_aims")
    there = (
        F.when(on_comment, F.coalesce("_comment", F.lit(comments is None)) & ~F.col("kind").isin(*TEXT_KINDS))
        .when(F.col("kind").isin(*VERDICTS), F.coalesce("_text", "_revision", F.lit(False)))
        .otherwise(F.coalesce("_text", F.lit(False)))
    )
    rows = rows.withColumn("why", F.when((F.col("why") == "") & ~there, "TARGET_NOT_FOUND").otherwise(F.col("why")))
    going = F.col("why") == ""
    taken = [F.when(going, F.col(c)).alias(c) for c in ("line", "old", "new", "shown")]
    return rows.select("doc_id", "line_no", "anchor", "kind", "ordinal", "scope", "why", "pass_no", (going & F.col("folds")).alias("folds"), *taken)


def _verdict() -> list[Column]:
    """state and decided_by of the first verdict, which may be null."""
    state = F.when(F.col("_verdict.kind") == "accept_revision", "accepted").when(F.col("_verdict.kind") == "reject_revision", "rejected").otherwise("pending")
    return [state.alias("state"), F.col("_verdict.line_no").alias("decided_by")]


def decided(verdicts: DataFrame, revisions: DataFrame) -> DataFrame:
    """revisions with state and decided_by: the first verdict whose target holds the revision, itself or its paragraph."""
    first = verdicts.groupBy("doc_id", F.col("anchor").alias("_target")).agg(F.min(F.struct("line_no", "kind")).alias("_verdict"))
    keyed = revisions.withColumn("_target", F.explode(F.array_distinct(F.filter(F.array("anchor", "paragraph"), lambda a: a.isNotNull()))))
    met = keyed.join(first, ["doc_id", "_target"], "left").groupBy(*revisions.columns).agg(F.min("_verdict").alias("_verdict"))
    return met.select(*revisions.columns, *_verdict())


def apply_edits(lines: DataFrame, paragraphs: DataFrame, comments: DataFrame | None = None, revisions: DataFrame | None = None, author: str = AUTHOR, prefix: bool = True, default_confidence: str = "Medium") -> Applied:
    """What becomes of each line, and the changed tables."""
    texts = _unique(paragraphs.select("doc_id", "anchor", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "anchor"], ["text"])
    said = None if comments is None else _unique(comments, ["doc_id", "ordinal"], ["author", "text", "anchor"])

    rows = settled(_targets(_read(lines, prefix, default_confidence), paragraphs, said, revisions))  # lines are parsed once for all that follows
    edits = rows.filter("folds").select("doc_id", "anchor", "line_no", "line", "kind", "old", "new", "shown")

    # a paragraph whose first verdict rejects goes back to the text before the first pass, and loses its footnotes
    verdicts = rows.filter("why = '' and pass_no = 2").select("doc_id", "anchor", "line_no", "kind")
    first = verdicts.groupBy("doc_id", "anchor").agg(F.min(F.struct("line_no", "kind")).alias("_verdict"))
    back = F.coalesce(F.col("_verdict.kind") == "reject_revision", F.lit(False))
    now = F.when(back, F.col("text_before")).otherwise(F.col("text"))
    final = settled(folded(edits, texts).join(first, ["doc_id", "anchor"], "left").select("doc_id", "anchor", now.alias("text"), back.alias("_back"), "done", "notes", "_verdict"))
    done = final.select("doc_id", "anchor", F.col("text").alias("_text_after"), F.explode("done").alias("d")).select("doc_id", "anchor", "_text_after", "d.*")

    # tracked changes: those of the first pass, which have no anchor of their own and are decided with their paragraph, and those that were there
    piece = lambda kind, text, line_no: F.struct(F.lit(kind).alias("kind"), text.alias("text"), line_no.alias("line_no"))
    made = F.flatten(F.transform(F.filter("done", lambda d: d["why"] == ""), lambda d: F.array(piece("del", d["deleted"], d["line_no"]), piece("ins", d["inserted"], d["line_no"]))))
    made = F.array_distinct(F.concat(F.filter(made, lambda p: p["text"] != ""), F.transform("notes", lambda n: piece("footnote", n["body"], n["line_no"]))))
    null = F.lit(None).cast("string")
    tracked = final.select("doc_id", null.alias("anchor"), F.col("anchor").alias("paragraph"), "_verdict", F.explode(made).alias("p"))
    judged = tracked.select("doc_id", "anchor", "paragraph", "p.kind", F.lit(author).alias("author"), "p.text", "p.line_no", *_verdict())
    used = final.filter(F.size(made) > 0).select("doc_id", F.col("_verdict.line_no").alias("line_no"))
    if revisions is not None:
        there = decided(verdicts, revisions.select("doc_id", "anchor", "paragraph", "kind", "author", "text", F.lit(None).cast("long").alias("line_no")))
        judged = there.unionByName(judged)
        used = used.unionByName(there.select("doc_id", F.col("decided_by").alias("line_no")))
    used = used.filter("line_no is not null").distinct().withColumn("_used", F.lit(True))

    # lines of the fold bring their paragraph's text; of the others only those that go on look for it
    others = rows.filter("not folds").select("doc_id", "line_no", "pass_no", "why", "anchor")
    on, stopped = others.filter("why = ''"), others.filter("why != ''").withColumn("_text_after", null)
    if revisions is not None:
        ruled = on.filter("pass_no = 2").join(used, ["doc_id", "line_no"], "left").withColumn("why", F.when(F.col("_used").isNull(), "NO_REVISIONS").otherwise("")).drop("_used")
        on = on.filter("pass_no = 1").unionByName(ruled)
    on = on.join(final.select("doc_id", "anchor", F.col("text").alias("_text_after")), ["doc_id", "anchor"], "left")
    plan = done.select("doc_id", "line_no", F.lit(1).alias("pass_no"), "why", "anchor", "_text_after").unionByName(on).unionByName(stopped)
    plan = plan.withColumn("status", F.when(F.col("why") == "", "Applied").otherwise("Skipped"))

    spoken = done.filter("why = '' and shown is not null").select("doc_id", F.lit(None).cast("long").alias("parent"), F.lit(author).alias("author"), F.col("shown").alias("text"), "anchor", "line_no")
    beside = rows.filter("not folds and shown is not null").select("doc_id", F.when(F.col("kind") == "reply_to_comment", F.col("ordinal")).alias("parent"), F.lit(author).alias("author"), F.col("shown").alias("text"), F.when(F.col("ordinal").isNull(), F.col("anchor")).otherwise(F.col("scope")).alias("anchor"), "line_no")
    spoken = spoken.unionByName(beside)
    highest = None if said is None else said.groupBy("doc_id").agg(F.max("ordinal").alias("_last"))
    spoken = spoken.withColumn("_last", F.lit(0).cast("long")) if highest is None else spoken.join(highest, "doc_id", "left")
    order = Window.partitionBy("doc_id").orderBy("line_no", "text")
    spoken = spoken.withColumn("ordinal", F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).drop("_last")
    if said is not None:
        spoken = said.withColumn("parent", F.lit(None).cast("long")).withColumn("line_no", F.lit(None).cast("long")).unionByName(spoken)

    return Applied(
        plan=plan.select("doc_id", "line_no", "pass_no", "status", "why", "anchor", F.when(F.col("why") == "", F.col("_text_after")).alias("text_after")),
        paragraphs=final.select("doc_id", "anchor", "text"),
        comments=spoken.select("doc_id", "ordinal", "parent", "author", "text", "anchor", "line_no"),
        revisions=judged.select("doc_id", "anchor", "paragraph", "kind", "author", "text", "line_no", "state", "decided_by"),
        footnotes=final.filter("not _back").select("doc_id", "anchor", F.explode("notes").alias("n")).select("doc_id", "anchor", "n.at", "n.body", "n.line_no"),
    )


def apply_plan(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The plan alone, where comments and revisions aren't known: pass, status, reason, and the paragraph's text behind all lines."""
    return apply_edits(lines, paragraphs).plan
