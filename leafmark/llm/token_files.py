"""Token files: flat unsigned integers plus 64-bit document offsets, memory-mapped by readers.

Documents are dealt to files by ranges of their id, then of their text's hash, and sorted inside, so that file order and
id order agree and a repeated id is split. A file consists of three parts of one name:
  .bin  all token ids, little-endian, 16 bits each where the vocabulary and the end id allow, else 32
  .idx  64-bit little-endian offsets in tokens from the beginning of the whole corpus, one per document and the end
  .ids  64-bit document ids; null ids come first, their number in each file is in the manifest
The first pass writes .bin, .ids and the lengths; the bases of files are prefix sums of the files' totals, one row per
file; the second writes .idx. A file is written under a temporary name and then renamed, so a repeated task is harmless.

Executors write to the shared folder as a mounted path (file:), or through pyarrow's file systems, where readers fetch
ranges instead of mapping.

Defined results: null text counts as empty and holds the end id alone; rows that repeat an id follow each other in the
order of their texts' XXH64; an empty table makes no files and no rows; further columns are ignored; strings of special
tokens inside texts become their ids, as in the library's plain call; a width that can't hold the vocabulary is refused.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.llm.pieces import Memory, slices
from leafmark.llm.shared import new_path, staged

END_ID = 2
#: Documents that one file should hold, and bytes of text.
FILE_DOCS = 8192
FILE_BYTES = 64 << 20
MOST_TASKS = 10000
#: Ids that a reader takes from a file at once.
READ_TOKENS = 1 << 20
#: Bytes of distinct pieces with their ids that a worker remembers as recent, and pieces that it encodes in one string.
REMEMBERED = 112 << 20
JOINED = 4096

MANIFEST = "file int, path string, docs long, nulls long, tokens long, width int"
WRITTEN = pa.schema({"file": pa.int32(), "path": pa.string(), "docs": pa.int64(), "nulls": pa.int64(), "tokens": pa.int64(), "width": pa.int32()})


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def write_file(path: str, parts: Iterator[bytes]) -> None:
    """Write under a temporary name in the same folder, then rename."""
    store, place = _store(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        for data in parts:
            out.write(data)
    store.move(part, place)


def mapped(path: str, dtype: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """The numbers of a flat file, mapped where it is mounted."""
    store, place = _store(path)
    size = np.dtype(dtype).itemsize
    if store.type_name == "local":
        found = os.path.getsize(place) // size
        n = found - start if count is None else count
        return np.memmap(place, dtype=dtype, mode="r", offset=start * size, shape=(n,)) if n else np.zeros(0, dtype=dtype)
    with store.open_input_file(place) as f:
        n = f.size() // size - start if count is None else count
        return np.frombuffer(f.read_at(n * size, start * size), dtype=dtype)


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str) -> Memory:
    """Encodes texts by a tokenizers file; one for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    spaced = np.zeros(own.get_vocab_size(), dtype=bool)
    spaced[[i for token, i in own.get_vocab().items() if token.startswith("\u0120")]] = True  # byte-level vocabularies write a space so

    def each(strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in own.encode_batch_fast(strings, add_special_tokens=False)]

    def encode(strings: list[str]) -> list[bytes]:
        """Pieces that begin with their only space are encoded in one string: the tokens with a space begin the pieces."""
        out: list[bytes] = []
        for at in range(0, len(strings), JOINED):
            part = strings[at : at + JOINED]
            ids = np.frombuffer(each(["".join(part)])[0], dtype="<u4")
            cuts = np.flatnonzero(spaced[ids])
            if len(cuts) == len(part) and all(s.rfind(" ") == 0 for s in part):
                data, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
                out += [data[a:z] for a, z in zip((cuts * 4).tolist(), ends)]
            else:
                out += each(part)
        return out

    return Memory(lambda spaced, others: encode(spaced) + encode(others), REMEMBERED)


def least_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that every id of the vocabulary and the end id fit in: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values()) < 1 << 16 else 4


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int | None = None, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode and write all of docs; the manifest: one row per file with its base, the number of tokens before it."""
    least = least_width(tokenizer_path, end_id)
    width = least if width is None else width
    if width < least:
        raise ValueError(f"ids of this vocabulary need {least} bytes")
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    files = max(1, -(-n // file_docs), -(-(size or 0) // FILE_BYTES))
    # rows that agree in id and text are split by where they stand in the input
    placed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(files, "id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "text", F.spark_partition_id().alias("file"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        memory, lengths, ids, nulls = encoder(tokenizer_path), [], [], 0
        file = first.column(2)[0].as_py()

        def parts() -> Iterator[bytes]:
            nonlocal nulls
            for b in chain([first], batches):
                ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls += b.column(0).null_count
                for texts in slices(b.column(1)):
                    tokens, ends = memory.of(texts)
                    lengths.append(np.diff(ends) + 1)
                    out = np.full(len(tokens) + len(texts), end_id, dtype=f"<u{width}")
                    own = np.ones(len(out), dtype=bool)
                    own[np.cumsum(lengths[-1]) - 1] = False
                    out[own] = tokens
                    yield out.tobytes()

        path = f"{folder}/{file:08d}"
        write_file(f"{path}.bin", parts())
        write_file(f"{path}.ids", iter([a.tobytes() for a in ids]))
        write_file(f"{path}.len", iter([a.astype("<i8").tobytes() for a in lengths]))
        row = {"file": file, "path": path, "docs": sum(map(len, lengths)), "nulls": nulls, "tokens": int(sum(a.sum() for a in lengths)), "width": width}
        yield pa.RecordBatch.from_pylist([row], schema=WRITTEN)

    totals = staged(dealt.mapInArrow(write, MANIFEST), "token-totals")
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                offsets = row.base + np.concatenate(([0], np.cumsum(mapped(f"{row.path}.len", "<i8"))))
                write_file(f"{row.path}.idx", iter([offsets.astype("<i8").tobytes()]))
            yield pdf

    spread = based.repartition(min(files, MOST_TASKS), "file")
    return staged(spread.mapInPandas(index, MANIFEST + ", base long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                offsets, ids = mapped(f"{row.path}.idx", "<i8"), mapped(f"{row.path}.ids", "<i8")
                tokens, base, at = mapped(f"{row.path}.bin", f"<u{row.width}"), int(offsets[0]), 0
                while at < row.docs:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_TOKENS, side="right")) - 1)
                    block = tokens[int(offsets[at]) - base : int(offsets[to]) - base].astype("<u4").tobytes()
                    cut = ((offsets[at : to + 1] - offsets[at]) * 4).tolist()
                    number = pd.array(np.asarray(ids[at:to]), dtype="Int64")
                    number[: max(0, min(to, row.nulls) - at)] = pd.NA
                    yield pd.DataFrame({"id": number, "start": np.asarray(offsets[at:to]), "n_tokens": np.diff(offsets[at : to + 1]), "ids_crc32": [zlib.crc32(block[a:z]) for a, z in zip(cut, cut[1:])]})
                    at = to

    return manifest.repartition(max(1, min(manifest.count(), MOST_TASKS)), "file").mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
