"""Reading ZIP archives by byte ranges: the central directory, in its ZIP64 form too, and spans of stored members."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

#: Fixed values of the ZIP format: signatures, and the fields' values that send the reader to the ZIP64 ones.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
STORED = 0


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def _at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"the archive ends before byte {offset + size}")
    return data


def _directory(f: BinaryIO, length: int) -> tuple[int, int]:
    """Offset and size of the central directory."""
    tail_at = max(0, length - 22 - FULL16)
    tail = _at(f, tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive: it has no end record")
    count, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if tail_at + end >= 20:
        locator = _at(f, tail_at + end - 20, 20)
        if locator[:4] == LOCATOR64 and (FULL16 == count or FULL32 in (size, offset)):
            record = _at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            size, offset = struct.unpack_from("<QQ", record, 40)
    return offset, size


def members(f: BinaryIO, length: int) -> dict[str, Member]:
    """The archive's members by name."""
    offset, size = _directory(f, length)
    data, at, out = _at(f, offset, size), 0, {}
    while at < len(data):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, x = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            x += 4 + n
        out[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin in the archive."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = _at(f, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def read_range(f: BinaryIO, start: int, offset: int, size: int) -> bytes:
    """`size` bytes at `offset` of a member whose data begin at `start`."""
    return _at(f, start + offset, size)
