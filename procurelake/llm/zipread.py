"""Directory of a ZIP package, ZIP64 included, read through any seekable file; stored members are read in ranges."""

from __future__ import annotations

import struct
from dataclasses import dataclass

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_STORED = 0


class BadPackage(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise BadPackage(f"{size} bytes asked for at {start}, {len(data)} there")
    return data


def _directory_place(file, total: int) -> tuple[int, int, int]:
    """Number of entries, size and start of the central directory."""
    tail_size = min(total, 22 + _FULL16)
    tail = read_range(file, total - tail_size, tail_size)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = total - tail_size + at
    if _FULL16 == count or _FULL32 in (size, start):
        locator = read_range(file, end - 20, 20) if end >= 20 else b""
        if locator[:4] == _LOCATOR:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = read_range(file, where, 56)
            if record[:4] != _END64:
                raise BadPackage("no ZIP64 end of central directory where the locator points")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
    return count, size, start


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values of which those that are all ones are replaced, in order, from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            inner, out = at + 4, []
            for value in values:
                if value == _FULL32 and inner + 8 <= at + 4 + size:
                    value = struct.unpack_from("<Q", extra, inner)[0]
                    inner += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def members(file, total: int) -> dict[str, Member]:
    """Members by name, from the central directory; ``total`` is the package's size in bytes."""
    count, size, start = _directory_place(file, total)
    data, at, found = read_range(file, start, size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != _ENTRY:
            raise BadPackage("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain = struct.unpack_from("<II", data, at + 20)
        name_size, extra_size, note_size = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        plain, packed, header = _wide(extra, [plain, packed, header])
        found[name] = Member(name, method, plain, packed, header)
        at += 46 + name_size + extra_size + note_size
    return found


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin in the package."""
    if member.method != _STORED:
        raise BadPackage(f"{member.name} is compressed as a whole; ranges of it can't be read")
    head = read_range(file, member.header, 30)
    if head[:4] != _LOCAL:
        raise BadPackage(f"no local header of {member.name}")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_size + extra_size
