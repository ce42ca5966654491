from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmark.functions import jsonl as J
from leafmark.functions import markup as M
from leafmark.functions import text as T
from leafmark.functions.diff import MOST_CELLS, word_diff
from leafmark.functions.fingerprint import BASES, PRIMES, SALT_PERIOD, SEEDS, fingerprint, fingerprint_sql
from leafmark.operators.edits import minimal_span


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def reference_fingerprint(s):
    a, b = SEEDS
    data = s.encode("utf-16-le")
    for i in range(1, len(data) // 2 + 1):
        c = data[2 * i - 2] | data[2 * i - 1] << 8
        a = (a * BASES[0] + c + 1) % PRIMES[0]
        b = (b * BASES[1] + c + i % SALT_PERIOD + 1) % PRIMES[1]
    return f"{a:08X}{b:08X}"


def test_fingerprint_forms_agree(spark):
    texts = ["", "a", "ba", "hello world", "\U0001f600", "x" * 251, "x" * 252, "back\\slash\r\n", "é" * 700]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", fingerprint(F.col("s")).alias("a"), fingerprint_sql(F.col("s")).alias("b")).collect()
    assert all(r.a == r.b == reference_fingerprint(r.s) for r in rows)


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (lambda: T.trim_ws(F.col("s")), "\t a \r\n", "a"),
        (lambda: T.normalize_punctuation(F.col("s")), "“a”—‘b’ c", "\"a\"-'b' c"),
        (lambda: T.strip_anchor_tokens(F.col("s")), "see AR_PARA_00001 and AR_CELL_1_2_3 end", "see and end"),
        (lambda: T.json_escape(F.col("s")), 'a\\b"c\r\nd\t', 'a\\\\b\\"c\\n\\nd\\t'),
        (lambda: T.safe_file_token(F.col("s")), " a/b:c\n ", "a_b_c"),
        (lambda: T.safe_file_token(F.col("s")), " \n ", None),
        (lambda: T.clean_one_line(F.col("s")), " a\r\nb — c ", "a b - c"),
        (lambda: T.file_base_name(F.col("s")), "C:\\x\\my file. .docx", "my file"),
        (lambda: T.file_base_name(F.col("s")), "C:\\x\\.docx", "Export"),
        (lambda: T.working_copy_path(F.col("s")), "C:\\x\\a_AR.docx", "C:\\x\\a_AR.docx"),
        (lambda: T.working_copy_path(F.col("s")), "C:\\x.y\\a", "C:\\x.y\\a_AR"),
        (lambda: T.working_copy_path(F.col("s")), "a.docx", ""),
        (lambda: T.is_docx_name(F.col("s")), "A.DocX", True),
        (lambda: T.format_date(F.col("s")), "2026-05-14T09:12:00Z", "2026-05-14"),
        (lambda: T.format_date(F.col("s")), "T9", "T9"),
        (lambda: T.format_window(F.col("s")), "2026-05-14T09:12:33Z", "2026-05-14T09:12Z"),
        (lambda: T.slugify(F.col("s")), " A. Person ", "a-person"),
        (lambda: T.slugify(F.col("s")), "--", "unknown"),
        (lambda: T.word_count(F.col("s")), "a b　c\n", 3),
        (lambda: T.word_count(F.col("s")), "", 0),
        (lambda: T.estimated_tokens(F.col("s")), "abcde", 2),
        (lambda: T.excerpt(F.col("s"), 3), "abcd", "abc…"),
        (lambda: T.containing_sentence(F.col("s"), F.lit(7)), "One. Two here! Three", "Two here!"),
        (lambda: T.containing_sentence(F.col("s"), F.lit(0)), "", ""),
        (lambda: T.emphasis(F.col("s"), F.lit(True), F.lit(True)), " a ", " ***a*** "),
        (lambda: T.emphasis(F.col("s"), F.lit(True), F.lit(False)), "  ", "  "),
        (lambda: T.ratified_anchor(F.col("s")), " [2] bookmark: AR_PARA_1 ", "AR_PARA_1"),
        (lambda: T.ratified_anchor(F.col("s")), "[2] ACTION: x", None),
        (lambda: T.is_top_heading(F.col("s")), "## x", False),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, column(), s=text) == want


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ('{"bookmark_id":"AR_PARA_1","change_type":"delete_element"}', ""),
        (' {"bookmark_id" : "A" ,\t"change_type":"Replace_Text","new_text":"x"}\r', ""),
        ('{"bookmark_id":"A","bookmark_id":3,"change_type":"delete_element","x":{"y":"} \\" ["}}', ""),
        ('{"bookmark_id":"A","change_type":"delete_element","n":-3.5e2,"z":null,"l":["a","b}"]}', ""),
        ("", "PARSE"),
        (None, "PARSE"),
        ("{}", "PARSE"),
        ("{", "PARSE"),
        ('{"bookmark_id":"A","change_type":"delete_element"}}', "PARSE"),
        ('{"bookmark_id":"A","change_type":"delete_element",}', "PARSE"),
        ('{"bookmark_id":"A\\', "PARSE"),
        ('{"bookmark_id":true,"change_type":"delete_element"}', "PARSE"),
        ("```jsonl", "PARSE"),
        ('{"bookmark_id":" ","change_type":""}', "MISSING_BOOKMARK"),
        ('{"bookmark_id":"A","change_type":" "}', "MISSING_CHANGE_TYPE"),
        ('{"bookmark_id":"AR_COMMENT_1","change_type":"add_footnote"}', "FOOTNOTE_REQUIRES_RANGE_TARGET"),
        ('{"bookmark_id":"A","change_type":"reply_to_comment"}', "REPLY_REQUIRES_COMMENT_TARGET"),
    ],
)
def test_edit_lines(spark, line, reason):
    assert one(spark, J.reason_of(J.edit_of(J.pairs_of(F.col("s")))), s=line) == reason


def test_unescape_and_three_valued_flags(spark):
    assert J.unescape("a\\u2014\\uD83D\\uDE00\\q\\u12\\/") == "a—\U0001f600qu12/"
    edit = J.edit_of(J.pairs_of(F.col("s")))["apply_change"]
    head = '{"bookmark_id":"A","change_type":"delete_element"'
    assert [one(spark, edit, s=head + t + "}") for t in (',"apply_change":true', ',"apply_change":false', ',"apply_change":"true"', "")] == [True, False, None, None]


@pytest.mark.parametrize(("count", "ok"), [("3", True), ("-0", True), ("+1", False), ("1.0", False), ("-1", False), ("1234567890", False), ('"3"', False)])
def test_meta_counts(spark, count, ok):
    line = f'{{"meta":"review","session":"S","count":{count}}}'
    assert (one(spark, J.meta_of(J.pairs_of(F.col("s")), "review"), s=line) is not None) == ok


def test_markup_tokens_strip_and_errors():
    text = "a {++x++} b {--c--} {~~o~>n~~} {==h==}{>>k<<}{>>z<<}"
    error, at, tokens, stripped = M.read(text)
    assert error is None and stripped == "a  b c o h"
    assert [(t[0], t[4], t[5]) for t in tokens] == [("ins", 2, 2), ("del", 5, 6), ("sub", 7, 8), ("comment", 9, 10), ("comment", 10, 10)]
    for bad, place in (("a {++b {--c--}++}", 2), ("{++a", 0), ("{==a==} x", 0), ("{~~a~~}", 0), ("x{>>y", 1)):
        assert M.read(bad)[1] == place
    assert M.read("{1} {+ fine")[0] is None
    assert M.read("{++legend++} body", skip=12)[2] == []


def test_whole_paragraph_tokens():
    flags = lambda s: [t[9] for t in M.read(s)[2]]
    assert flags("a\n{++p++}\nb") == [True]
    assert flags("a\n{++p++}{++q++}\nb") == [True, True]
    assert flags("a {++p++}\nb") == [False]
    assert flags("a\n{~~p~>q~~}\nb") == [False]


def test_word_diff_restores_both_sides():
    rng = random.Random(6)
    words = "the a of to and in is".split()
    for _ in range(150):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(2))
        segments = word_diff(a, b)
        assert "".join(t for k, t in segments if k != "add") == a and "".join(t for k, t in segments if k != "del") == b
        assert all(x[0] != y[0] for x, y in zip(segments, segments[1:]))
    assert word_diff("x " * 2200, "y z " * 1100) is None and MOST_CELLS == 4_000_000
    same = "w " * 20000
    assert word_diff(same + "a" + same, same + "b" + same)[1:3] == [("del", "aw"), ("add", "bw")]


def test_minimal_span(spark):
    span = minimal_span(F.col("a"), F.col("b"))
    r = one(spark, span, a="the cat sat", b="the dog sat")
    assert (r.prefix, r.suffix, r.middle) == (4, 4, "dog")
    r = one(spark, span, a="aa", b="aaa")
    assert (r.prefix, r.suffix, r.middle) == (2, 0, "a")
    assert one(spark, span, a="“x”—", b='"x"-') is None
    r = one(spark, span, a="", b="new")
    assert (r.prefix, r.suffix, r.middle) == (0, 0, "new")


def test_every_reason_has_a_message(spark):
    assert all(one(spark, J.message_of(F.col("s")), s=code) == text for code, text in list(J.MESSAGES.items())[::5]) and one(spark, J.message_of(F.col("s")), s="") is None


def test_rows_reach_python_in_batches_of_bounded_bytes(spark, tmp_path):
    from leafmark.plans.inputs import texts

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(300).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 1600) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes], pa.int64())})

    found = [r.n for r in texts(spark, str(tmp_path)).mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 300 * 64 * 1600 and max(found) < 8 << 20


def test_pastes_of_short_texts_agree_with_their_sql(spark, tmp_path):
    import duckdb

    from leafmark.plans import registry

    spark.createDataFrame([(i, t) for i, t in enumerate(["", "", "", "abcd", "abcd", "abcd", "abcde", "abcde", "abcde", None, None, None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = registry.queries()["envelope_candidates"](spark, str(tmp_path)).select("doc_id", "n", "best").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.execute(f"SELECT doc_id, n, best FROM ({registry.oracle_sql()['envelope_candidates']}) ORDER BY doc_id").fetchall()
