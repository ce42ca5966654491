"""ZIP packages with some entries replaced: the others keep their compressed bytes, checksums, times and attributes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from dataclasses import dataclass

# fixed values: the format's signatures, and its limits without the 64-bit extension
LOCAL, CENTRAL, END = b"PK\3\4", b"PK\1\2", b"PK\5\6"
MOST_ENTRIES, MOST_BYTES = 0xFFFF, 1 << 32
DESCRIPTOR, UTF8 = 1 << 3, 1 << 11


@dataclass(frozen=True)
class Entry:
    """An entry as it will be written; `data` is compressed."""

    name: bytes
    flags: int
    method: int
    stamp: tuple[int, int]
    crc: int
    size: int
    data: bytes
    made_by: int = 20
    internal: int = 0
    external: int = 0

    def fields(self) -> bytes:
        return struct.pack("<HHHHHIIIHH", 20, self.flags, self.method, *self.stamp, self.crc, len(self.data), self.size, len(self.name), 0)


def _stamp(when: tuple[int, int, int, int, int, int]) -> tuple[int, int]:
    y, mo, d, h, mi, s = when
    return h << 11 | mi << 5 | s // 2, (y - 1980) << 9 | mo << 5 | d


def kept(content: bytes, info: zipfile.ZipInfo) -> Entry:
    """The entry with the compressed bytes that stand in the package."""
    at = info.header_offset
    if content[at : at + 4] != LOCAL:
        raise ValueError(f"no entry at the place of {info.filename}")
    name, extra = struct.unpack_from("<HH", content, at + 26)
    start = at + 30 + name + extra
    data = content[start : start + info.compress_size]
    if len(data) != info.compress_size:
        raise ValueError(f"{info.filename} is cut off")
    coded = info.orig_filename.encode("utf-8" if info.flag_bits & UTF8 else "cp437")
    return Entry(coded, info.flag_bits & ~DESCRIPTOR, info.compress_type, _stamp(info.date_time), info.CRC, info.file_size, data, info.create_system << 8 | info.create_version, info.internal_attr, info.external_attr)


def made(name: str, content: bytes) -> Entry:
    """A new or changed entry, deflated, with the earliest time: the same again in every run."""
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    plain = name.isascii()
    return Entry(name.encode(), 0 if plain else UTF8, zipfile.ZIP_DEFLATED, _stamp((1980, 1, 1, 0, 0, 0)), zlib.crc32(content), len(content), packer.compress(content) + packer.flush())


def patched(content: bytes, changes: dict[str, bytes], most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> bytes:
    """The package with changed entries in their places and new ones behind, in the order of their names.

    A package that would hold more than 65,535 entries or reach 4 GiB is refused before anything is compressed.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        infos = package.infolist()
    names = {i.filename for i in infos}
    added = sorted(set(changes) - names)
    if len(infos) + len(added) > most_entries:
        raise ValueError(f"a package can't hold {len(infos) + len(added)} entries")
    if sum(len(c) for c in changes.values()) + sum(i.compress_size for i in infos if i.filename not in changes) >= most_bytes:
        raise ValueError("a package can't hold 4 GiB")
    entries = [made(i.filename, changes[i.filename]) if i.filename in changes else kept(content, i) for i in infos] + [made(n, changes[n]) for n in added]
    out, directory = io.BytesIO(), io.BytesIO()
    for e in entries:
        place = out.tell()
        out.write(LOCAL + e.fields() + e.name + e.data)
        directory.write(CENTRAL + struct.pack("<H", e.made_by) + e.fields() + struct.pack("<HHHII", 0, 0, e.internal, e.external, place) + e.name)
    start, held = out.tell(), directory.getvalue()
    if start + len(held) + 22 >= most_bytes:
        raise ValueError("a package can't hold 4 GiB")
    return out.getvalue() + held + END + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(held), start, 0)
