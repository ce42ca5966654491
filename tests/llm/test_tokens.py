from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from leafmark.llm import bpe, token_files
from leafmark.llm.pieces import Recent

ODD = [None, "", " ", "  two  gaps ", "a", "it's we'll", "tab\there", "line\nline\n\nend ", "no-break space", "emoji \U0001f600 x", "<|endoftext|> plain", "é ü ñ 12345", "x" * 3000, "ab" * 400 + " tail", "　wide", "word " * 3000, " lead", "trail \n", "\x1c\x85 odd"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("etaoin shrdlu,.\n'") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = bpe.encode(frame(spark, texts), *bpe.public_vocabulary())
    got = {r.id: bytes(r.ids) for r in rows.collect()}
    assert got == {i: np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for i, t in enumerate(texts)}
    back = {r.id: bytes(r.bytes) for r in bpe.decode(rows, *bpe.public_vocabulary()).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_round_trip_digests(spark, library):
    for r in bpe.round_trip(frame(spark, ODD), *bpe.public_vocabulary()).collect():
        text = ODD[r.id] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(library.encode_ordinary(text))


def test_words_of_any_length_are_contracted(library):
    own = bpe.vocabulary(*bpe.public_vocabulary())
    rng = random.Random(9)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 60, 150, 400) for letters in ("aeinrst", "ab", "x", "abcdefghijklmnopqrstuvwxyz", "\u0939\u093f\u0928", "=-")]
    words += ["a" * 5001, "-" * 3000, "the" * 500, "\u6f22\u5b57" * 500, "xabc" * 200]
    held = [w.encode() for w in words]
    want = [np.array(library._encode_single_piece(w) if len(w) > 1 else [own.ranks[w]], dtype="<u4").tobytes() for w in held]
    assert own.contract(held) == want
    assert own.contract(held[:12], short=4) == want[:12] == own.contract(held[:12], short=1 << 30)
    assert own.contract(held[12:24], query_rows=20000) == want[12:24]
    assert own.contract([]) == [] and own.contract([b""]) == [b""]
    ids = [x for x in want if x]
    assert own.decode(ids, query_tokens=77) == [w for w in held if w]


def test_memory_is_bounded_by_bytes():
    memory, asked = Recent(most=2000), 0
    for at in range(0, 200, 5):
        keys = [f"{i}" for i in range(at, at + 10)]
        new = memory.missing(keys)
        asked += len(new)
        memory.add(new, [k.encode() for k in new])
        assert memory.of(keys) == [k.encode() for k in keys]
        assert len(memory.young) + len(memory.old) < 60
    assert asked < 400


def test_unknown_id_stops(spark):
    rows = spark.createDataFrame([(1, (4_000_000).to_bytes(4, "little"))], "id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(rows, *bpe.public_vocabulary()).collect()


@pytest.mark.parametrize("file_docs", [4, 1000])
def test_token_files_read_back(spark, file_docs):
    from tokenizers import Tokenizer

    path = token_files.default_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "another"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = token_files.read_tokens(token_files.write_tokens(docs, path, file_docs=file_docs)).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1] or "", 42)))):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_token_files_split_a_repeated_id_and_check_the_width(spark):
    path = token_files.default_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(7, f"text {i % 9}") for i in range(400)], "doc_id long, text string")
    manifest = token_files.write_tokens(docs, path, file_docs=50)
    assert manifest.count() >= 6 and token_files.read_tokens(manifest).count() == 400
    wide = token_files.read_tokens(token_files.write_tokens(docs, path, width=4)).collect()
    assert {(r.n_tokens, r.ids_crc32) for r in wide} == {(r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(manifest).collect()}
    assert token_files.least_width(path, 70000) == 4
    with pytest.raises(ValueError, match="4 bytes"):
        token_files.write_tokens(docs, path, end_id=70000, width=2)


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_tokens(token_files.write_tokens(docs, token_files.default_path("byte_bpe_50k.json"))).count() == 0
    assert bpe.encode(docs, *bpe.public_vocabulary()).count() == 0
