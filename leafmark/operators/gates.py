"""The fidelity gates: grammar (G1), equality of the stripped response (G2), anchors (G3) and protection (G4), and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions.markup import tokenized
from leafmark.functions.text import SPACE, normalize_newlines, word_count
from leafmark.operators import anchors as A
from leafmark.operators.edits import bound, common_prefix

LARGEST_DELETION = 50


def first_divergence(a: Column, b: Column, around: int = 120) -> Column:
    """offset and texts around the first difference."""
    cut = lambda s, at, n: F.substring(s, at + 1, F.lit(n))

    def told(t: Column, at: Column) -> Column:
        start = F.greatest(at - around, F.lit(0))
        return F.struct(at.alias("offset"), F.substring(t["a"], start + 1, at - start).alias("before"), cut(t["a"], at, around).alias("after_a"), cut(t["b"], at, around).alias("after_b"))

    return bound(F.struct(a.alias("a"), b.alias("b")), lambda t: bound(common_prefix(t["a"], t["b"]), lambda at: told(t, at)))


def read_responses(responses: DataFrame) -> DataFrame:
    """responses(doc_id, response, exported, header_length) as what the gates need of them: doc_id, r (error, error_at,
    tokens), and whether the header is there and the stripped response equals the export. The texts themselves stay behind."""
    response, exported = normalize_newlines(F.col("response")), normalize_newlines(F.col("exported"))
    plain = responses.select("doc_id", response.alias("response"), exported.alias("exported"), "header_length")
    read = plain.withColumn("r", tokenized(F.col("response"), F.col("header_length")))
    header = F.startswith("response", F.substring("exported", F.lit(1), F.col("header_length").cast("int")))
    told = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("error", "error_at", "tokens")])
    return read.select("doc_id", told.alias("r"), header.alias("header_kept"), (F.col("r.stripped") == F.col("exported")).alias("text_kept"))


def edits_of(read: DataFrame) -> DataFrame:
    """One row per token: doc_id, edit_id in raw order, and its fields."""
    return read.filter("r.error is null").select("doc_id", F.posexplode("r.tokens").alias("edit_id", "t")).select("doc_id", "edit_id", "t.*")


def text_gates(read: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document the first failing gate of phase one: gate and at (a place in the response), null where all pass."""
    edits = edits_of(read)
    crossing = A.crossing_blocks(edits, blocks).join(edits.select("doc_id", "edit_id", "raw_start"), ["doc_id", "edit_id"]).groupBy("doc_id").agg(F.min("raw_start").alias("_cross"))
    broken = edits.filter(F.contains("new_text", F.lit("\n"))).groupBy("doc_id").agg(F.min("raw_start").alias("_line"))
    rows = read.join(crossing, "doc_id", "left").join(broken, "doc_id", "left")
    none = F.lit(None).cast("int")
    found = (
        F.when(~F.col("header_kept"), F.struct(F.lit("G2").alias("gate"), none.alias("at")))
        .when(F.col("r.error").isNotNull(), F.struct(F.lit("G1").alias("gate"), F.col("r.error_at").alias("at")))
        .when(F.col("_cross").isNotNull(), F.struct(F.lit("G1").alias("gate"), F.col("_cross").alias("at")))
        .when(F.col("_line").isNotNull(), F.struct(F.lit("G1").alias("gate"), F.col("_line").alias("at")))
        .when(~F.col("text_kept"), F.struct(F.lit("G2").alias("gate"), none.alias("at")))
    )
    return rows.select("doc_id", found["gate"].alias("gate"), found["at"].alias("at"))


def anchor_gates(edits: DataFrame, runs: DataFrame, blocks: DataFrame, locked: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Per edit the gate of phase two: G4 where it touches protected text or nothing but synthetic text, G3 where text isn't
    covered, else null. The deletion of a whole paragraph whose span is a block's is anchored to the block, so neither its
    prefix nor other synthetic text inside counts."""
    wide = edits.filter("md_end > md_start")
    whole = A.whole_deletions(wide.filter("type = 'del' AND whole_paragraph"), blocks).select("doc_id", "edit_id").distinct().withColumn("_whole", F.lit(True))
    held = A.overlapping_locked(wide, locked).select("doc_id", "edit_id").distinct().withColumn("_held", F.lit(True))
    snapped = A.snap(wide.select("doc_id", "edit_id", "md_start", "md_end"), synthetic)
    inner = snapped.select("doc_id", "edit_id", F.col("snap_start").alias("md_start"), F.col("snap_end").alias("md_end"))
    ranges = A.resolve_ranges(inner.filter("md_end > md_start"), runs, locked).select("doc_id", "edit_id", F.col("error").alias("_range"))
    spans = inner.join(ranges, ["doc_id", "edit_id"], "left").join(held, ["doc_id", "edit_id"], "left").join(whole, ["doc_id", "edit_id"], "left")
    gate = F.when(F.col("_held"), "G4").when(F.col("_whole"), F.lit(None)).when(F.col("md_end") <= F.col("md_start"), "G4").when(F.col("_range") == "locked", "G4").when(F.col("_range").isNotNull(), "G3")
    points = edits.filter("md_end <= md_start").select("doc_id", "edit_id", F.col("md_start").alias("pos"), "whole_paragraph")
    inside = A.resolve_points(points.filter("not whole_paragraph"), runs, locked)
    between = A.resolve_boundaries(points.filter("whole_paragraph"), blocks)
    return (
        spans.select("doc_id", "edit_id", gate.alias("gate"))
        .unionByName(inside.select("doc_id", "edit_id", F.when(F.col("error") == "locked", "G4").when(F.col("error").isNotNull(), "G3").alias("gate")))
        .unionByName(between.select("doc_id", "edit_id", F.when(F.col("block_seq").isNull(), "G3").alias("gate")))
    )


def verdicts(text: DataFrame, anchored: DataFrame) -> DataFrame:
    """Per document the first failing gate of both phases: that of phase one, else that of the first failing edit."""
    second = anchored.filter("gate is not null").groupBy("doc_id").agg(F.min_by("gate", "edit_id").alias("_gate"))
    return text.join(second, "doc_id", "left").select("doc_id", F.coalesce("gate", "_gate").alias("gate"))


def chunk_verdicts(chunk_gates: DataFrame, anchored: DataFrame) -> DataFrame:
    """Per document of chunk_gates(doc_id, chunk_index, gate) the gate of its first chunk that fails phase one, with its index.

    Only where every chunk passes do the merged edits of anchored(doc_id, edit_id, gate) count, without an index.
    """
    failed = F.when(F.col("gate").isNotNull(), F.struct("chunk_index", "gate"))
    first = chunk_gates.groupBy("doc_id").agg(F.min(failed).alias("_first"))
    second = anchored.filter("gate IS NOT NULL").groupBy("doc_id").agg(F.min_by("gate", "edit_id").alias("_gate"))
    return first.join(second, "doc_id", "left").select("doc_id", F.coalesce("_first.gate", "_gate").alias("gate"), F.col("_first.chunk_index").alias("chunk_index"))


def edit_counts(edits: DataFrame) -> DataFrame:
    return edits.groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("ins", "del", "sub", "comment")])


def oversized_deletions(edits: DataFrame, most: int = LARGEST_DELETION) -> DataFrame:
    words = word_count(F.col("old_text"))
    return edits.filter(F.col("type").isin("del", "sub") & (words > most)).select("doc_id", "edit_id", words.cast("long").alias("words"))


def duplicate_comments(edits: DataFrame) -> DataFrame:
    """Comments of equal text in a document: text, number and raw places."""
    key = F.regexp_replace("comment_text", rf"\A{SPACE}+|{SPACE}+\z", "")
    return edits.filter("type = 'comment'").groupBy("doc_id", key.alias("text")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("raw_start")).alias("raw_starts")).filter("n > 1")
