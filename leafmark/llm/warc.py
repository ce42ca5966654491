"""WARC archives: a writer with revisit records, and a splittable reader of gzip-per-record files.

Every record is a gzip member of its own. A reading task gets a range of bytes of a file, scans it for the gzip magic,
takes a candidate for a member only if its first bytes decode to a WARC header, and from there on follows members; it owns
the records that start inside its range, and reads the last one beyond the range's end.

Defined results: null payloads are empty; null URLs have no target header and are read back as null; a null page id is
written as `null` and read back as null; line ends in URLs are written as %0D and %0A; of equal payloads of at least `least` bytes the smallest non-null page id is the
response, rows that repeat it are responses too; an empty table makes no records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import new_path, staged
from leafmark.llm.token_files import _store, write_file

LEAST_BYTES = 100
#: Bytes of a file that one task reads, and bytes fetched at once.
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
MOST_TASKS = 10000
DATE = "2026-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One gzip member."""
    block = HTTP if revisit else HTTP + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _name(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = f"sha256:{digest}"
    head["X-Payload-Length"] = str(len(payload))
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(text.encode() + block + b"\r\n\r\n") + gz.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archive files, one per partition; the files: path, bytes, records.

    Only ids and digests are grouped; payloads are shuffled once, by id, to meet what they revisit.
    """
    folder = new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    keys = staged(rows.select("id", "digest", (F.octet_length("payload") >= least).alias("large")), "payload-digests")
    first = keys.filter("large").groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "refers_to")
    later = keys.filter("large").join(staged(first, "first-payloads"), "digest").filter("refers_to is not null and not (id <=> refers_to)").distinct()
    later = staged(later.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"), "revisits")
    joined = rows.join(later.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []

        def members() -> Iterator[bytes]:
            for b in batches:
                for i, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    data = record(i, url, payload, digest, revisit, refers_to)
                    sizes.append(len(data))
                    yield data

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        write_file(path, members())
        yield pa.record_batch({"path": [path], "bytes": pa.array([sum(sizes)], pa.int64()), "records": pa.array([len(sizes)], pa.int64())})

    plain = joined.select("id", "url", "payload", F.lower(F.hex("digest")).alias("digest"), F.col("_digest").isNotNull().alias("revisit"), "refers_to")
    return staged(plain.mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Tail:
    """A file's bytes from a place on, fetched in blocks."""

    def __init__(self, file, place: int):
        self.file, self.place, self.data = file, place, b""

    def more(self) -> bool:
        self.file.seek(self.place + len(self.data))
        new = self.file.read(READ_BYTES)
        self.data += new
        return bool(new)

    def skip(self, n: int) -> None:
        self.place, self.data = self.place + n, self.data[n:]


def _is_member(tail: _Tail) -> bool:
    """Whether the tail begins with a gzip member that holds a WARC record."""
    while len(tail.data) < 512 and tail.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(tail.data[:512], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(tail: _Tail) -> bytes:
    """The member that the tail begins with, decoded; the tail then begins behind it."""
    gz, out = zlib.decompressobj(31), []
    while True:
        fed = len(tail.data)
        out.append(gz.decompress(tail.data))
        tail.skip(fed - len(gz.unused_data))
        if gz.eof:
            return b"".join(out)
        if not tail.more():
            raise ValueError("an archive ends inside a record")


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded records that start in [start, end) of an open file."""
    tail = _Tail(file, start)
    while tail.place < end:
        at = tail.data.find(MAGIC)
        if at < 0:
            tail.skip(max(0, len(tail.data) - len(MAGIC) + 1))
            if not tail.more():
                return
            continue
        tail.skip(at)
        if tail.place >= end:
            return
        if _is_member(tail):
            yield _member(tail)
        else:
            tail.skip(1)


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; a response's payload must have the digest that its header tells."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


SCHEMA = {"id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
COLUMNS = "id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def read_archives(files: DataFrame, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of files(path, bytes), read in ranges; revisits have no payload of their own."""
    names = [n for n in SCHEMA if payload or n != "payload"]
    ranges = files.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns)):
                store, place = _store(path)
                with store.open_input_file(place) as file:
                    rows, size = [], 0
                    for data in records_in(file, start, start + split_bytes):
                        rows.append(parse_record(data))
                        size += len(data)
                        if size > READ_BYTES * 4:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    # a number of tasks of its own, or adaptive execution would join the few bytes of all ranges in one
    spread = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))
    return spread.mapInArrow(read, COLUMNS + ", payload binary" * payload)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], SCHEMA[n]) for n in names], names=names)


def archives(spark, folder: str) -> DataFrame:
    """The files of a folder as read_archives takes them; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))
