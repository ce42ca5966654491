"""Validation of long documents chunk by chunk: split, check each chunk's response alone, then all edits once.

exports(doc_id, exported); blocks(doc_id, block_seq, kind, md_start, md_end) in the document's coordinates; responses(doc_id,
chunk_index, response); runs, locked and synthetic spans as in `anchors`.

The second and later top headings begin chunks. Phase one (grammar, equality) sees a chunk's response, text and blocks in
the chunk's own coordinates; a chunk is the key of the same set operators that check whole documents, so chunks of one
document are checked apart from each other and on different tasks. The first failing chunk decides for its document, and only
documents without one go on to phase two, with the edits of all chunks in the document's coordinates.

Defined results: null exports are empty; a document without blocks, or with one top heading at most, is one chunk; a chunk
without a response fails with `NO_RESPONSE`; responses to chunks or documents that don't exist are ignored; of repeated
responses to a chunk the smallest text counts; documents that are there twice are one (the smallest text); empty tables give
empty tables; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import SPACE, is_top_heading
from leafmark.operators import blocks as B
from leafmark.operators import gates as G
from leafmark.staging import settled

NO_RESPONSE = "NO_RESPONSE"


@dataclass(frozen=True)
class Checked:
    """verdicts: doc_id, gate, chunk_index and at (phase one: the chunk and the place in its response), edit_id (phase two).

    edits: the edits of documents that passed phase one, with edit_id in the document's order, chunk_index, and offsets in the
    document; raw offsets stay those of the chunk's response.
    """

    verdicts: DataFrame
    edits: DataFrame


def split(exports: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks: doc_id, chunk_index, base_offset, exported, header_length; and their blocks in chunk coordinates."""
    texts = exports.groupBy("doc_id").agg(F.min(F.coalesce("exported", F.lit(""))).alias("exported"))
    shown = blocks.join(texts, "doc_id").withColumn("_top", (F.col("kind") == "heading") & is_top_heading(F.substring(F.col("exported"), (F.col("md_start") + 1).cast("int"), F.lit(3))))
    chunked = B.chunks(shown.drop("exported"), F.coalesce("_top", F.lit(False))).drop("_top")
    bases = chunked.groupBy("doc_id", "chunk_index").agg(F.first("base_offset").alias("base_offset"), F.min("md_start").alias("_first"))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    found = texts.join(bases, "doc_id", "left").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0).cast("long"))).withColumn("base_offset", F.coalesce("base_offset", F.lit(0).cast("long")))
    end = F.coalesce(F.lead("base_offset").over(order), F.length("exported").cast("long"))
    piece = F.substring(F.col("exported"), (F.col("base_offset") + 1).cast("int"), (end - F.col("base_offset")).cast("int"))
    head = F.coalesce(F.col("_first") - F.col("base_offset"), end - F.col("base_offset")).cast("int")
    header = F.regexp_replace(F.substring(piece, F.lit(1), head), rf"{SPACE}+\z", "")
    return found.select("doc_id", "chunk_index", "base_offset", piece.alias("exported"), F.length(header).alias("header_length")), B.rebased(chunked)


def _by_chunk(rows: DataFrame) -> DataFrame:
    """rows with doc and chunk as the key of the document operators."""
    return rows.withColumn("doc_id", F.struct("doc_id", "chunk_index")).drop("chunk_index")


def check(exports: DataFrame, blocks: DataFrame, responses: DataFrame, runs: DataFrame, locked: DataFrame, synthetic: DataFrame) -> Checked:
    """Both phases for every document of exports."""
    pieces, chunk_blocks = split(exports, blocks)
    pieces = settled(pieces)
    given = responses.groupBy("doc_id", "chunk_index").agg(F.min("response").alias("response"))
    asked = pieces.join(given, ["doc_id", "chunk_index"], "left")
    answered = _by_chunk(asked.filter("response is not null").drop("base_offset"))
    read = settled(G.read_responses(answered))  # tokens are read for both phases
    told = G.text_gates(read, _by_chunk(chunk_blocks)).select("doc_id.*", "gate", "at")
    absent = pieces.select("doc_id", "chunk_index").join(read.select("doc_id.*"), ["doc_id", "chunk_index"], "left_anti")  # not from responses, which would be made again
    absent = absent.select("doc_id", "chunk_index", F.lit(NO_RESPONSE).alias("gate"), F.lit(None).cast("int").alias("at"))
    failed = told.filter("gate is not null").unionByName(absent).groupBy("doc_id").agg(F.min(F.struct("chunk_index", "gate", "at")).alias("_f"))
    first = settled(failed.select("doc_id", "_f.*"))

    own = G.edits_of(read).select("doc_id.*", *[c for c in G.edits_of(read).columns if c != "doc_id"])
    moved = B.translate_edits(own.join(first.select("doc_id"), "doc_id", "left_anti"), pieces)
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "edit_id")
    merged = settled(moved.withColumn("edit_id", (F.row_number().over(order) - 1).cast("long")))
    second = G.anchor_gates(merged, runs, blocks, locked, synthetic).filter("gate is not null").groupBy("doc_id").agg(F.min(F.struct("edit_id", "gate")).alias("_s"))
    documents = pieces.select("doc_id").distinct()
    verdicts = documents.join(first, "doc_id", "left").join(second, "doc_id", "left")
    return Checked(verdicts.select("doc_id", F.coalesce("gate", "_s.gate").alias("gate"), "chunk_index", "at", F.when(F.col("gate").isNull(), F.col("_s.edit_id")).alias("edit_id")), merged)
