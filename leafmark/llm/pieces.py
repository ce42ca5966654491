"""Cutting texts where every byte-level BPE pattern cuts them too, so that equal pieces are encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space next to white space, or any white space but the space and the line feed: such texts stay whole.
_WIDE = r"[ \n] | \n|[\t\x{000B}-\r\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Bytes of distinct pieces with their ids that a task remembers as recent; as many older ones are kept beside them.
REMEMBERED = 16 << 20
#: What an entry of a dictionary of Python's strings and bytes takes besides their contents.
ENTRY_BYTES = 180
#: Bytes of text that are cut and encoded at a time.
SLICE_BYTES = 9 << 18


class Recent:
    """A memory of so many bytes in two generations: what was asked for since the last turn, and before it."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def missing(self, keys: list) -> list:
        """Those of some distinct keys that aren't known; the others stay known until the next call."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        new = set(keys) - self.young.keys()
        again = new & self.old.keys()
        self.add(list(again), list(map(self.old.__getitem__, again)))
        return list(new - again)

    def add(self, keys: list, values: list[bytes]) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + ENTRY_BYTES * len(keys)

    def of(self, keys: list) -> list[bytes]:
        """The value of each of some known keys, in order."""
        return list(map(self.young.__getitem__, keys))


def spread(values: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of values[p] for each place, end to end, and the number of ids up to each place (one more than places)."""
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    data = np.frombuffer(b"".join(values), dtype="<u4")
    n = lengths[places]
    ends = np.concatenate(([0], np.cumsum(n)))
    first = (np.cumsum(lengths) - lengths)[places]
    return data[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


class Memory:
    """Encodings of texts. encode: strings that begin with their only space, and others, to the ids of all, as little-endian
    unsigned 32-bit integers.

    A text is cut before each single space: a pattern's match holds a space only as its first character (`" ?letters"`,
    `" ?digits"`, `" ?others"`) or inside a run of white space, and a text with such runs isn't cut.
    """

    def __init__(self, encode: Callable[[list[str], list[str]], list[bytes]], most: int = REMEMBERED):
        self.encode, self.spaced = encode, Recent(most)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of ids up to each text (one more than texts)."""
        wide = pc.match_substring_regex(texts, _WIDE)
        cut = pc.split_pattern(pc.if_else(wide, "", texts), " ")
        starts = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        places, known = pieces.indices.to_numpy().copy(), pieces.dictionary.to_pylist()
        # the first piece of a text has no space; a text that isn't cut is one
        heads = pc.if_else(wide, texts, pc.list_element(cut, 0)).dictionary_encode()
        whole = heads.dictionary.to_pylist()
        new = self.spaced.missing(known)
        made = self.encode([" " + p for p in new], whole)
        self.spaced.add(new, made[: len(new)])
        values = self.spaced.of(known) + [i if t else b"" for t, i in zip(whole, made[len(new) :])]
        places[starts[:-1] - starts[0]] = len(known) + heads.indices.to_numpy()
        ids, ends = spread(values, places)
        return ids, ends[starts - starts[0]]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column of strings or binaries in order, a bounded number of bytes at a time, one value at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield column.slice(at, to - at)
        at = to
