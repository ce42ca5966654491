"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark's tasks.

A task cuts its texts by the vocabulary's pattern and encodes the distinct words it hasn't met. Words that are tokens are
looked up; the others become token-position rows that a recursive query contracts: each round joins neighbouring tokens
with the merge table and contracts every word's leftmost pair of minimum rank, until no word has a pair. Decoding joins
the ids with the vocabulary and concatenates each document's bytes by an ordered aggregation.

Words of any length go this way. They are cut beforehand between bytes that no token holds next to each other, which no
merge can join. Of a part over `SHORT` bytes a round contracts all pairs of the minimum rank that the leftmost-first order
would contract one after the other: every second one of a run, and only where the merged token is in no pair of a lower
rank. A query runs so many rounds that its rows stay below `QUERY_ROWS`, then the next goes on with what isn't at its end.

Defined results: null and empty texts have no ids; equal and repeated rows are encoded alike; null ids are carried; an
empty table gives no rows; further columns are ignored; ids outside the vocabulary stop the job. Encoded texts of a
slice, at least one document, are in a task's memory at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.pieces import Memory, Recent, slices, spread

#: Bytes of a part of a word of which a round contracts one pair; of longer ones it contracts many.
SHORT = 64
#: Bytes that one recursive query begins with, rows that it makes, tokens that one query decodes.
QUERY_BYTES = 1 << 18
QUERY_ROWS = 1 << 21
QUERY_TOKENS = 1 << 17
#: Bytes of words with their ids that a task remembers as recent; as many older ones are kept beside them.
REMEMBERED = 32 << 20

#: Rows of step: a token at a place, the place and the token after it in its word, and the rank of both together. One
#: number tells rank and place of the pair that is contracted: its token is its rank.
CONTRACT_ONE = """
SELECT s.round + 1 AS round, s.word, s.pos, CASE WHEN s.pos = h.pos THEN h.tok ELSE s.tok END AS tok,
       CASE WHEN s.pos = h.pos THEN h.next_pos ELSE s.next_pos END AS next_pos,
       CASE WHEN s.pos = h.pos THEN h.next_tok WHEN s.next_pos = h.pos THEN h.tok ELSE s.next_tok END AS next_tok
FROM step s JOIN (
  SELECT b.word, b.best & 1099511627775 AS pos, (b.best >> 40)::INTEGER AS tok, b.gone, g.next_pos, g.next_tok
  FROM (SELECT word, min((rank::BIGINT << 40) | pos) AS best, arg_min(next_pos, (rank::BIGINT << 40) | pos) AS gone
        FROM step WHERE rank IS NOT NULL AND round < {rounds} GROUP BY word) b
  JOIN step g ON g.pos = b.gone) h ON h.word = s.word
WHERE s.pos != h.gone
"""

CONTRACT_MANY = """
WITH low AS (SELECT word, min((rank::BIGINT << 40) | pos) AS best FROM step WHERE rank IS NOT NULL AND round < {rounds} GROUP BY word),
hits AS (
  SELECT s.word, s.pos, s.next_pos, s.rank FROM step s JOIN low ON low.word = s.word AND s.rank = low.best >> 40
  WHERE s.pos = low.best & 1099511627775 OR s.rank NOT IN (SELECT rank FROM early)),
runs AS (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY word ORDER BY pos) AS run, row_number() OVER (PARTITION BY word ORDER BY pos) AS n
  FROM (SELECT *, coalesce(lag(next_pos) OVER (PARTITION BY word ORDER BY pos) != pos, true) AS fresh FROM hits)),
taken AS (SELECT pos, next_pos, rank FROM (SELECT *, n - min(n) OVER (PARTITION BY word, run) AS k FROM runs) WHERE k % 2 = 0),
merged AS (SELECT t.pos, t.rank AS tok, g.next_pos, g.next_tok FROM taken t JOIN step g ON g.pos = t.next_pos),
left_over AS (
  SELECT s.round, s.word, s.pos, coalesce(a.tok, s.tok) AS tok, CASE WHEN a.pos IS NULL THEN s.next_pos ELSE a.next_pos END AS next_pos,
         CASE WHEN a.pos IS NULL THEN s.next_tok ELSE a.next_tok END AS next_tok
  FROM step s JOIN low ON low.word = s.word LEFT JOIN merged a ON a.pos = s.pos WHERE s.pos NOT IN (SELECT next_pos FROM taken))
SELECT l.round + 1 AS round, l.word, l.pos, l.tok, l.next_pos, coalesce(t.rank, l.next_tok) AS next_tok
FROM left_over l LEFT JOIN taken t ON t.pos = l.next_pos
"""

#: The last round's rows of each word, and whether a pair is left.
CONTRACT = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, l.word, l.pos, l.tok, l.next_pos, l.next_tok, m.rank
  FROM letters l LEFT JOIN merges m ON m.pair = (l.tok::BIGINT << 32) | l.next_tok
  UNION ALL
  SELECT x.round, x.word, x.pos, x.tok, x.next_pos, x.next_tok, m.rank
  FROM ({contracted}) x LEFT JOIN merges m ON m.pair = (x.tok::BIGINT << 32) | x.next_tok)
SELECT s.word, s.pos, s.tok, s.next_pos, s.next_tok, l.more
FROM step s JOIN (
  SELECT word, round, bool_or(rank IS NOT NULL) AS more FROM step
  GROUP BY word, round QUALIFY round = max(round) OVER (PARTITION BY word)) l ON l.word = s.word AND l.round = s.round
"""

DECODE = """
SELECT t.doc, string_agg(v.bytes, '' ORDER BY t.pos) AS text, count(v.id) AS found, count(*) AS n
FROM tokens t LEFT JOIN vocabulary v ON v.id = t.id GROUP BY t.doc ORDER BY t.doc
"""


class Vocabulary:
    """The ranks of a tiktoken file in a DuckDB database of this process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        # the queries' rows are bounded, so nothing is spilled
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        pairs = [(x, y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        first, second, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        del pairs
        self._load("merges", {"pair": (first << 32) | second, "rank": rank.astype(np.int32)})
        # tokens that are in a pair of a lower rank than their own: what is contracted next may stand before the next such token
        self._load("early", {"rank": np.unique(np.concatenate((first[rank < first], second[rank < second]))).astype(np.int32)})
        # bytes travel as the 256 Latin-1 characters, since an ordered aggregation concatenates strings only
        self._load("vocabulary", {"id": np.fromiter(ranks.values(), dtype=np.uint32), "bytes": [t.decode("latin-1") for t in ranks]})
        self.letter = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.adjoin = np.zeros(1 << 16, dtype=bool)  # two bytes that some token holds next to each other
        for t in ranks:
            self.adjoin[[a << 8 | b for a, b in zip(t, t[1:])]] = True
        self.words = Recent(REMEMBERED)
        self.memory = Memory(self._encode_pieces)

    def _load(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(name, rows)
        found = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return found

    def _cut(self, pieces: list[str]) -> tuple[list[str], list[int]]:
        """The words of all pieces, and their number up to each piece (one more than pieces)."""
        cut = [self.pattern.findall(p) for p in pieces]
        return [w for each in cut for w in each], np.cumsum([0, *map(len, cut)]).tolist()

    def _encode_pieces(self, spaced: list[str], others: list[str]) -> list[bytes]:
        """Pieces that begin with their only space are cut in one string: the words with a space begin the pieces."""
        words = self.pattern.findall("".join(spaced))
        cuts = [i for i, w in enumerate(words) if w[0] == " "] + [len(words)]
        if len(cuts) != len(spaced) + 1 or not all(p.rfind(" ") == 0 for p in spaced):
            words, cuts = self._cut(spaced)
        more, ends = self._cut(others)
        cuts += [len(words) + e for e in ends[1:]]
        distinct = pa.array(words + more, pa.string()).dictionary_encode()
        known = distinct.dictionary.to_pylist()
        new = self.words.missing(known)
        self.words.add(new, self.encode_words(new))
        ids, ends = spread(self.words.of(known), distinct.indices.to_numpy())
        data, at = ids.tobytes(), (ends[cuts] * 4).tolist()
        return [data[a:z] for a, z in zip(at, at[1:])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each merged on its own, as little-endian unsigned 32-bit integers."""
        out, hard, encoded = [b""] * len(words), [], []
        for i, word in enumerate(words):
            w = word.encode()
            token = self.ranks.get(w)
            if token is None:
                hard.append(i)
                encoded.append(w)
            else:
                out[i] = token.to_bytes(4, "little")
        at, ends = 0, np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)))
        while at < len(hard):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + QUERY_BYTES, side="right")))
            for i, ids in zip(hard[at:to], self.contract(encoded[at:to])):
                out[i] = ids
            at = to
        return out

    def contract(self, words: list[bytes], short: int = SHORT, query_rows: int = QUERY_ROWS) -> list[bytes]:
        """The ids of some words, contracted by the recursive query."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begins = np.zeros(len(data), dtype=bool)
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        begins[1:] |= ~self.adjoin[data[:-1].astype(np.uint16) << 8 | data[1:]]
        part, ends = np.cumsum(begins, dtype=np.int32) - 1, np.append(begins[1:], True)[: len(data)]
        tok = self.letter[data]
        after = pa.array(np.arange(1, len(data) + 1), mask=ends), pa.array(np.append(tok[1:], 0).astype(np.int32)[: len(data)], mask=ends)
        letters = pa.table({"word": part, "pos": np.arange(len(data)), "tok": tok, "next_pos": after[0], "next_tok": after[1]})
        few = np.bincount(part)[part] <= short if len(data) else begins
        pos, ids = [], []
        for mask, contracted in ((few, CONTRACT_ONE), (~few, CONTRACT_MANY)):
            rows = letters.filter(pa.array(mask))
            while rows.num_rows:
                found = self._query("letters", rows, CONTRACT.format(contracted=contracted.format(rounds=max(1, query_rows // rows.num_rows))))
                more = found["more"].to_numpy()
                pos.append(found["pos"].to_numpy()[~more])
                ids.append(found["tok"].to_numpy()[~more])
                rows = found.filter(pa.array(more)).drop_columns(["more"])
        if not pos:
            return [b""] * len(words)
        place = np.concatenate(pos)
        order = np.argsort(place)
        cuts = (np.searchsorted(place[order], np.concatenate(([0], np.cumsum(lengths)))) * 4).tolist()
        flat = np.concatenate(ids)[order].astype("<u4").tobytes()
        return [flat[a:z] for a, z in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        ids, ends = self.memory.of(texts)
        data, at = ids.tobytes(), (ends * 4).tolist()
        return [data[a:z] for a, z in zip(at, at[1:])]

    def decode(self, ids: list[bytes], query_tokens: int = QUERY_TOKENS) -> list[bytes]:
        """The bytes of each document's ids, some tokens at a time; a document may go over several queries."""
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, doc = np.frombuffer(b"".join(ids), dtype="<u4"), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        out: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), query_tokens):
            rows = {"doc": doc[at : at + query_tokens], "pos": np.arange(len(doc[at : at + query_tokens]), dtype=np.int32), "id": flat[at : at + query_tokens]}
            for d, text, found, n in zip(*(c.to_pylist() for c in self._query("tokens", pa.table(rows), DECODE).columns)):
                if found != n:
                    raise ValueError("an id is not in the vocabulary")
                out[d].append(text.encode("latin-1"))
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    with open(ranks_path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}, pattern)


def _mapped(rows: DataFrame, schema: str, work: Callable[[pa.Array], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for values in slices(b.column(1)):
                yield pa.record_batch({"id": b.column(0).slice(at, len(values))} | work(values))
                at += len(values)
                # Arrow's pool would keep a slice's pages for the worker's whole life, also in later stages
                pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids: each row's token ids as little-endian unsigned 32-bit integers."""
    return _mapped(_texts(docs, id_col, text_col), "id long, ids binary", lambda texts: {"ids": pa.array(vocabulary(ranks_path, pattern).encode(texts), pa.binary())})


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """id and bytes of rows(id, ids)."""
    held = rows.select("id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return _mapped(held, "id long, bytes binary", lambda ids: {"bytes": pa.array(vocabulary(ranks_path, pattern).decode(ids.to_pylist()), pa.binary())})


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and decoded again in one pass: id, ids, n_tokens, ids_sha256, decoded_sha256."""

    def work(texts: pa.Array) -> dict:
        own = vocabulary(ranks_path, pattern)
        ids = own.encode(texts)
        digests = [[hashlib.sha256(x).hexdigest() for x in each] for each in (ids, own.decode(ids))]
        return {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": digests[0], "decoded_sha256": digests[1]}

    return _mapped(_texts(docs, id_col, text_col), "id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
