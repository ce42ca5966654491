"""Spark data sources of the review pipeline: packages as tables, and one file per reviewer pass.

`spark.read.format("docx").option("table", "segments").load(folder)` reads the tables of `docx` straight from packages:
parts (the default), segments, comments, comment_paragraphs, comment_extensions, footnotes. Files are dealt to partitions by bytes and a task
inflates only the parts that its table needs. The options pathGlobFilter and names (of files, separated by line feeds) choose
packages before any is opened. Filters on `path` are Spark's own work: Spark 4.1 keeps the partitions of the first filter that
a Python source takes for every later scan of the same frame, which then lacks rows.

`slices.write.format("pass_files").save(folder)` writes rows(name, text) as files. A task writes under a folder of its
attempt; the driver moves the files of committed tasks into place, so repeated or failed tasks leave nothing behind.

Files are reached through pyarrow's file systems, by the folder's URI. Register both with `register(spark)`.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from leafmark.sources import docx

PARTITION_BYTES = 128 << 20


def _opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a folder, the folder's path in it, and what stands before such paths in a URI."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return pafs.LocalFileSystem(), uri.rstrip("/"), "file:"
    system, path = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    return system, path.rstrip("/"), "file:" if isinstance(system, pafs.LocalFileSystem) else uri.rstrip("/").removesuffix(path.rstrip("/"))


@dataclass
class Files(InputPartition):
    """The packages of a partition, each with the path that its rows show."""

    found: tuple[tuple[str, str], ...]


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("a folder of packages must be given")
        self.table = _table(options)
        self.glob = options.get("pathglobfilter", "*.docx")
        self.recursive = options.get("recursivefilelookup", "false").lower() == "true"
        self.most = int(options.get("maxpartitionbytes", PARTITION_BYTES))
        self.names = {n for n in options.get("names", "").split("\n") if n}

    def wanted(self, name: str) -> bool:
        return fnmatch(name, self.glob) and (not self.names or name in self.names)

    def partitions(self) -> list[InputPartition]:
        """Packages in the order of their paths, as many to a partition as its bytes allow."""
        system, folder, scheme = _opened(self.folder)
        infos = system.get_file_info(pafs.FileSelector(folder, recursive=self.recursive))
        out, held, size = [], [], 0
        for i in sorted((i for i in infos if i.is_file and self.wanted(i.base_name)), key=lambda i: i.path):
            if held and size + i.size > self.most:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append((i.path, scheme + i.path))
            size += i.size
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, _ = _opened(self.folder)
        schema = docx.PART if self.table == "parts" else docx.TABLES[self.table][0]
        fields = pa.schema([(name, docx.TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])
        for path, shown in partition.found:
            with system.open_input_file(path) as f:
                content = f.read()
            if self.table == "parts":
                rows, most = docx._entries(shown, content), 1
            else:
                _, names, made = docx.TABLES[self.table]
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    there = set(package.namelist())
                    rows, most = made(shown, *(package.read(n) if n in there else None for n in names)), docx.ROWS
            for some in batched(rows, most):
                yield pa.RecordBatch.from_pylist(list(some), schema=fields)


def _table(options: dict[str, str]) -> str:
    name = options.get("table", "parts")
    if name != "parts" and name not in docx.TABLES:
        raise ValueError(f"packages have no table {name}; there are parts, {', '.join(docx.TABLES)}")
    return name


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        name = _table(self.options)
        return docx.PART if name == "parts" else docx.TABLES[name][0]

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class FileWriter(DataSourceWriter):
    """Rows(name, text) as files of UTF-8 text."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, folder, _ = _opened(self.folder)
        own = f"{self.pending}/{uuid.uuid4().hex}"
        system.create_dir(f"{folder}/{own}", recursive=True)
        names = []
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"{row['name']!r} is no name for a file")
            with system.open_output_stream(f"{folder}/{own}/{row['name']}") as f:
                f.write((row["text"] or "").encode())
            names.append(row["name"])
        return Written(own, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files of the tasks that Spark accepted; a name that is given twice stops the job before any is moved."""
        system, folder, _ = _opened(self.folder)
        named = sorted((n, m.folder) for m in messages if m for n in m.names)
        twice = next((a for (a, _), (b, _) in zip(named, named[1:]) if a == b), None)
        if twice or len(named) != sum(len(set(m.names)) for m in messages if m):
            self.abort(messages)
            raise ValueError(f"two rows are named {twice}")
        if self.overwrite:
            for i in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if i.is_file:
                    system.delete_file(i.path)
        for name, own in named:
            system.move(f"{folder}/{own}/{name}", f"{folder}/{name}")
        system.delete_dir(f"{folder}/{self.pending}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder, _ = _opened(self.folder)
        if system.get_file_info(f"{folder}/{self.pending}").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.pending}")


class PassFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pass_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if not {"name", "text"} <= set(schema.names):
            raise ValueError("rows need a name and a text")
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Both formats for this session."""
    spark.dataSource.register(Packages)
    spark.dataSource.register(PassFiles)
