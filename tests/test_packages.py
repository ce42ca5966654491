from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from test_docx import package, para, run

from leafmark.functions.text import slice_filename
from leafmark.operators import anchors as A
from leafmark.sources import archive, docx, inject, reader


def cell(*paragraphs):
    return f"<w:tc>{''.join(p if p.startswith('<w:p>') else para(run(p)) for p in paragraphs)}</w:tc>"


def table(*rows):
    return f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in map(''.join, rows))}</w:tbl>"


BODY = (
    para(run("before"))
    + table(
        [cell("Head one"), cell("Head two"), cell("3")],
        [cell("plain"), cell("a | b", "more"), cell(para(run(" bold", "<w:b/>"), run(" tail ")), "", "second")],
        [cell(""), cell("x")],
    )
    + para(run("after"))
)


@pytest.fixture(scope="module")
def packages(spark):
    return spark.createDataFrame([("/in/t.docx", package(BODY))], "path string, content binary")


def test_runs_of_cells_stand_where_they_are_shown(packages):
    entries = docx.parts(packages)
    shown = docx.export(entries).first().markdown
    assert "| Head one | Head two | 3 |\n| --- | --- | --- |\n| plain | a \\| b more | **bold** tail second |\n|   | x |   |" in shown
    got = [(r.body_idx, r.row_no, r.cell_no, r.para_no, r.run_index, r.char_offset, shown[r.md_start : r.md_end]) for r in docx.runs(entries).orderBy("md_start").collect()]
    assert got == [
        (0, None, None, 0, 0, 0, "before"),
        (1, 0, 0, 0, 0, 0, "Head one"),
        (1, 0, 1, 0, 0, 0, "Head two"),
        (1, 0, 2, 0, 0, 0, "3"),
        (1, 1, 0, 0, 0, 0, "plain"),
        (1, 1, 2, 0, 0, 1, "bold"),
        (1, 1, 2, 0, 1, 0, " "),
        (1, 1, 2, 0, 1, 1, "tail"),
        (1, 1, 2, 2, 0, 0, "second"),
        (1, 2, 1, 0, 0, 0, "x"),
        (2, None, None, 0, 0, 0, "after"),
    ]
    assert len({r.block_seq for r in docx.runs(entries).collect()}) == 9


def test_an_edit_inside_a_cell_resolves_and_is_injected(spark, packages):
    entries = docx.parts(packages)
    shown, runs = docx.export(entries).first().markdown, docx.runs(entries).persist()
    at = {w: shown.index(w) for w in ("tail", "two", "a \\|")}
    edits = spark.createDataFrame([("/in/t.docx", 0, at["tail"], at["tail"] + 4), ("/in/t.docx", 1, at["two"], at["two"] + 3), ("/in/t.docx", 2, at["a \\|"], at["a \\|"] + 1)], "doc_id string, edit_id int, md_start int, md_end int")
    none = spark.createDataFrame([], "doc_id string, s int, e int")
    ranges = A.resolve_ranges(edits, runs, none)
    assert {r.edit_id: r.error for r in ranges.collect()} == {0: None, 1: None, 2: "synthetic"}
    places = runs.select("doc_id", "block_seq", "body_idx", "row_no", "cell_no", "para_no").distinct()
    found = ranges.filter("error is null").select("doc_id", "edit_id", F.explode("triples").alias("t")).select("doc_id", "edit_id", "t.*").join(places, ["doc_id", "block_seq"])
    targets = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("body_idx", "row_no", "cell_no", "para_no", "run_index", "char_start", "char_end")])))
    rows = found.groupBy(F.col("doc_id").alias("path"), "edit_id").agg(targets.alias("targets"))
    rows = rows.withColumn("type", F.when(F.col("edit_id") == 0, "sub").otherwise("del")).withColumn("new_text", F.when(F.col("edit_id") == 0, "end")).withColumn("comment_text", F.lit(None).cast("string")).withColumn("whole", F.lit(None).cast("string"))
    out = inject.inject(entries, rows, "R", "2026-07-05T00:00:00Z", packages)
    assert "| Head one | Head {--two--} | 3 |\n| --- | --- | --- |\n| plain | a \\| b more | **bold** {~~tail~>end~~} second |" in docx.export(docx.parts(out)).first().markdown


# ---- packages as bytes


def made_package():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, method, level in (("word/document.xml", zipfile.ZIP_DEFLATED, 1), ("word/media/ü.bin", zipfile.ZIP_STORED, None), ("docProps/app.xml", zipfile.ZIP_DEFLATED, 9)):
            info = zipfile.ZipInfo(name, (2020, 2, 3, 4, 5, 6))
            info.external_attr, info.comment = 0o640 << 16, b"note"
            info.compress_type = method
            z.writestr(info, f"{name} content ".encode() * 300, compresslevel=level)
    return out.getvalue()


def raw(content):
    """Per entry its compressed bytes and what the directory says of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None
        return {i.filename: (archive.kept(content, i).data, i.CRC, i.compress_type, i.date_time, i.external_attr, i.file_size) for i in z.infolist()}


def test_untouched_entries_keep_their_bytes():
    old = made_package()
    new = archive.patched(old, {"docProps/app.xml": b"<new/>", "word/added.xml": b"<a/>", "word/añadido.xml": b"<b/>"})
    before, after = raw(old), raw(new)
    assert list(after) == ["word/document.xml", "word/media/ü.bin", "docProps/app.xml", "word/added.xml", "word/añadido.xml"]
    assert all(after[n] == before[n] for n in ("word/document.xml", "word/media/ü.bin"))
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("docProps/app.xml") == b"<new/>" and z.read("word/añadido.xml") == b"<b/>"
    assert archive.patched(old, {"a": b"x"}) == archive.patched(old, {"a": b"x"})


def test_entries_with_data_descriptors_are_taken():
    class Pipe(io.RawIOBase):
        """A target that can't seek, so that sizes follow the data."""

        def __init__(self):
            self.held = b""

        def writable(self):
            return True

        def write(self, b):
            self.held += bytes(b)
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "text " * 100)
        z.writestr("b.xml", "more " * 100)
    new = archive.patched(pipe.held, {"b.xml": b"changed"})
    assert raw(new)["a.xml"][:2] == raw(pipe.held)["a.xml"][:2]
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert (z.read("a.xml"), z.read("b.xml")) == (b"text " * 100, b"changed")


def test_packages_beyond_the_limits_are_refused():
    old = made_package()
    with pytest.raises(ValueError, match="4 entries"):
        archive.patched(old, {"new": b""}, most_entries=3)
    with pytest.raises(ValueError, match="4 GiB"):
        archive.patched(old, {"new": b"x" * 4000}, most_bytes=4000)
    with pytest.raises(ValueError, match="4 GiB"):
        archive.patched(old, {}, most_bytes=len(old) - 200)
    with pytest.raises(zipfile.BadZipFile):
        archive.patched(b"no package", {})


def test_patched_packages_as_a_table(spark):
    docs = spark.createDataFrame([("a", made_package()), ("b", made_package())], "path string, content binary")
    changed = spark.createDataFrame([("a", "docProps/app.xml", b"1"), ("a", "docProps/app.xml", b"2"), ("c", "x", b"3")], "path string, name string, content binary")
    got = {r.path: bytes(r.content) for r in docx.patched(docs, changed).collect()}
    assert got["b"] == made_package() and set(got) == {"a", "b"}
    with zipfile.ZipFile(io.BytesIO(got["a"])) as z:
        assert z.read("docProps/app.xml") == b"2"


# ---- data sources


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    reader.register(spark)
    path = tmp_path_factory.mktemp("packages")
    for i in range(5):
        note = '<w:comment w:id="0" w:author="A"><w:p w14:paraId="P0"><w:r><w:t>why</w:t></w:r></w:p></w:comment>'
        (path / f"p{i}.docx").write_bytes(package(para(run(f"text {i}")) + BODY, note if i % 2 else None, '<w15:commentEx w15:paraId="P0" w15:done="1"/>' if i == 3 else None))
    (path / "other.txt").write_text("no package")
    return str(path)


def test_the_source_reads_the_same_tables(spark, folder):
    held = docx.parts(docx.packages(spark, folder))
    read = lambda name, **o: spark.read.format("docx").options(table=name, **o).load(folder)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    assert same(read("segments"), docx.segments(held)) and same(read("parts"), held)
    notes, paragraphs, extended = docx._comment_tables(held)
    assert same(read("comments"), notes) and same(read("comment_paragraphs"), paragraphs) and same(read("comment_extensions"), extended)
    assert read("segments", maxPartitionBytes="1").rdd.getNumPartitions() == 5 and read("segments").rdd.getNumPartitions() == 1
    assert read("parts", pathGlobFilter="p1*").select("path").distinct().count() == 1
    with pytest.raises(Exception, match="no table pages"):
        read("pages").collect()


def test_options_choose_packages_and_frames_can_be_reused(spark, folder):
    with open(f"{folder}/broken.docx", "wb") as f:
        f.write(b"no package")
    read = lambda **o: spark.read.format("docx").options(table="segments", **o).load(folder)
    assert read(names="p2.docx\np4.docx").select("path").distinct().count() == 2
    rows = read(pathGlobFilter="p*.docx")
    assert [rows.filter(F.col("path").endswith(n)).select("path").distinct().count() for n in ("p2.docx", "p1.docx", ".docx")] == [1, 1, 5]
    with pytest.raises(Exception, match="zip"):
        read().count()


def test_only_needed_parts_are_read(folder, monkeypatch):
    asked = []
    plain = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: asked.append(name) or plain(self, name, *a))
    source = reader.PackageReader({"path": folder, "table": "comments", "pathglobfilter": "p*.docx"})
    assert sum(b.num_rows for p in source.partitions() for b in source.read(p)) == 2
    assert set(asked) <= set(docx.COMMENT_PARTS)


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_slices_are_written_as_files(spark, tmp_path, folder):
    passes = spark.createDataFrame([("Plan B", "Ann", "2026-01-01", "# one\n"), ("Plan B", "Bob", None, "zwei ü"), ("Plan C", "Ann", "2026-01-01", None)], "doc string, author string, date string, text string").repartition(3)
    rows = passes.select(slice_filename(F.col("doc"), F.col("author"), F.col("date")).alias("name"), "text")
    target = tmp_path / "out"
    rows.write.format("pass_files").mode("append").save(str(target))
    assert names(target) == ["plan-b_ann_2026-01-01.md", "plan-b_bob_undated.md", "plan-c_ann_2026-01-01.md"]
    assert (target / "plan-b_bob_undated.md").read_text() == "zwei ü" and (target / "plan-c_ann_2026-01-01.md").read_text() == ""
    rows.limit(1).write.format("pass_files").mode("overwrite").save(str(target))
    assert len(names(target)) == 1


def test_failed_writes_leave_nothing(spark, tmp_path, folder):
    target = tmp_path / "out"
    bad = spark.createDataFrame([(f"f{i}.md" if i != 7 else "a/b", "x") for i in range(9)], "name string, text string").repartition(4)
    with pytest.raises(Exception, match="no name for a file"):
        bad.write.format("pass_files").mode("append").save(str(target))
    twice = spark.createDataFrame([("same.md", "x"), ("same.md", "y"), ("z.md", "")], "name string, text string").repartition(3)
    with pytest.raises(Exception, match="named same.md"):
        twice.write.format("pass_files").mode("append").save(str(target))
    assert not target.exists() or names(target) == []


def test_a_repeated_task_counts_once(tmp_path):
    writer = reader.FileWriter({"path": str(tmp_path)}, False)
    first = writer.write(iter([{"name": "a.md", "text": "1"}]))
    again = writer.write(iter([{"name": "a.md", "text": "1"}]))
    writer.commit([again, None])
    assert first.folder != again.folder and names(tmp_path) == ["a.md"]
