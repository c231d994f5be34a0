"""EXIF fields: whether a block is sound, reading one, and changing one while all others stay byte for byte.

A change appends the new value, and a directory that gains or loses an entry, at
the end of the block and turns one offset to it, so nothing else moves. JPEG and
PNG files are changed; a block that is damaged is left as it is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.sources.metadata import PNG, user_comment

#: Bytes of a value of each TIFF type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Directories that tag 0x8769, 0x8825 and, in the EXIF one, 0xA005 point to.
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
#: Text fields by name: directory and tag.
FIELDS = {"ImageDescription": ("first", 0x010E), "Software": ("first", 0x0131), "Artist": ("first", 0x013B), "Copyright": ("first", 0x8298), "UserComment": ("exif", 0x9286)}
ORIENTATION = 0x0112
#: Bytes that a JPEG segment can hold.
SEGMENT = 65_533


class DamagedExif(ValueError):
    """A directory or a value that does not lie in the block."""


@dataclass(frozen=True)
class Entry:
    at: int
    tag: int
    kind: int
    count: int
    value: bytes


@dataclass(frozen=True)
class Directory:
    name: str
    at: int
    link: int  # where the offset that leads here stands
    entries: tuple[Entry, ...]


def directories(tiff: bytes) -> tuple[str, dict[str, Directory]]:
    """Byte order and the directories of a block: first, exif, gps, interop and thumbnail, as far as they are there."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        raise DamagedExif
    found: dict[str, Directory] = {}
    todo = [("first", 4)]
    while todo:
        name, link = todo.pop(0)
        (at,) = struct.unpack(order + "I", tiff[link : link + 4])
        if at < 8 or at + 2 > len(tiff) or any(d.at == at for d in found.values()):
            raise DamagedExif
        (n,) = struct.unpack(order + "H", tiff[at : at + 2])
        if at + 6 + 12 * n > len(tiff):
            raise DamagedExif
        entries = []
        for place in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack(order + "HHI", tiff[place : place + 8])
            size = SIZES.get(kind, 0) * count
            (start,) = (place + 8,) if size <= 4 else struct.unpack(order + "I", tiff[place + 8 : place + 12])
            if start + size > len(tiff):
                raise DamagedExif
            entries.append(Entry(place, tag, kind, count, tiff[start : start + size]))
            if tag in POINTERS and kind == 4 and count == 1:
                todo.append((POINTERS[tag], place + 8))
        found[name] = Directory(name, at, link, tuple(entries))
        after = at + 2 + 12 * n
        if name == "first" and struct.unpack(order + "I", tiff[after : after + 4])[0]:
            todo.append(("thumbnail", after))
    return order, found


def with_value(tiff: bytes, name: str, tag: int, kind: int, value: bytes | None) -> bytes:
    """The block with one field set, or left out for None; an empty block gives a new one."""
    if not tiff:
        if value is None:
            return tiff
        tiff = b"II*\0" + struct.pack("<IHI", 8, 0, 0)
    order, found = directories(tiff)
    out = bytearray(tiff)

    def appended(data: bytes) -> int:
        out.extend(b"\0" * (len(out) % 2))
        out.extend(data)
        return len(out) - len(data)

    def entry(tag: int, kind: int, data: bytes) -> bytes:
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", appended(data))
        return struct.pack(order + "HHI", tag, kind, len(data) // SIZES[kind]) + place

    def moved(directory: Directory, records: list[bytes]) -> None:
        """The directory anew at the end, with what follows its entries."""
        after = directory.at + 2 + 12 * len(directory.entries)
        at = appended(struct.pack(order + "H", len(records)) + b"".join(records) + bytes(out[after : after + 4]))
        out[directory.link : directory.link + 4] = struct.pack(order + "I", at)

    if name not in found:
        if value is None:
            return tiff
        at = appended(struct.pack(order + "H", 0) + bytes(4))  # an empty directory, and the pointer to it
        pointer = next(t for t, n in POINTERS.items() if n == name)
        record = struct.pack(order + "HHII", pointer, 4, 1, at)
        parent = found["first"]
        moved(parent, sorted([*(bytes(out[e.at : e.at + 12]) for e in parent.entries), record], key=lambda r: struct.unpack(order + "H", r[:2])))
        return with_value(bytes(out), name, tag, kind, value)
    directory = found[name]
    old = next((e for e in directory.entries if e.tag == tag), None)
    if old is not None and value is not None:
        out[old.at : old.at + 12] = entry(tag, kind, value)
    elif old is not None or value is not None:
        records = [bytes(out[e.at : e.at + 12]) for e in directory.entries if e is not old]
        if value is not None:
            records.append(entry(tag, kind, value))
        moved(directory, sorted(records, key=lambda r: struct.unpack(order + "H", r[:2])))
    return bytes(out)


# ---- the block in its file ----


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, marker) of a JPEG's segments up to its picture; a segment that reaches over the end is damage."""
    at = 2
    while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] not in (b"\xd9", b"\xda", b""):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise DamagedExif
        yield at, at + 2 + size, data[at + 1]
        at += 2 + size


def _chunks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, type) of a PNG's chunks; one that reaches over the end, or an EXIF one with another checksum, is damage."""
    at = len(PNG)
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8]
        if end > len(data) or (kind == b"eXIf" and zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big")):
            raise DamagedExif
        yield at, end, kind
        at = end


def located(data: bytes) -> tuple[int, int, bytes] | None:
    """(start, end, TIFF block) of the EXIF part of a JPEG or PNG; an empty block, where one belongs, if there is none; None for other files."""
    if data[:2] == b"\xff\xd8":
        place = 2
        for start, end, marker in _segments(data):
            if marker == 0xE1 and data[start + 4 : start + 10] == b"Exif\0\0":
                return start, end, data[start + 10 : end]
            place = end if marker == 0xE0 and start == 2 else place
        return place, place, b""
    if data[:8] == PNG:
        place = None
        for start, end, kind in _chunks(data):
            if kind == b"eXIf":
                return start, end, data[start + 8 : end - 4]
            place = end if place is None else place
        return (place, place, b"") if place is not None else None
    return None


def replaced(data: bytes, start: int, end: int, tiff: bytes) -> bytes:
    """The file with another block in place of the one at ``start``; as it is where a JPEG segment could not hold it."""
    if data[:2] == b"\xff\xd8":
        if len(tiff) + 8 > SEGMENT + 2:
            return data
        part = b"\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff if tiff else b""
    else:
        part = len(tiff).to_bytes(4, "big") + b"eXIf" + tiff + zlib.crc32(b"eXIf" + tiff).to_bytes(4, "big") if tiff else b""
    return data[:start] + part + data[end:]


def state(data: bytes) -> str:
    """``none``, ``sound`` or ``damaged``; ``unknown`` for other files than JPEG and PNG."""
    try:
        found = located(data)
        if found is None:
            return "unknown"
        if not found[2]:
            return "none"
        directories(found[2])
        return "sound"
    except DamagedExif:
        return "damaged"


def without_exif(data: bytes) -> bytes:
    """The file without its EXIF block, even a damaged one, pixels untouched; a file whose parts are damaged is left as it is."""
    try:
        found = located(data)
    except DamagedExif:
        return data
    return data if found is None or not found[2] else replaced(data, found[0], found[1], b"")


def _field(data: bytes, name: str) -> tuple[str, Entry] | None:
    found = located(data)
    if found is None or not found[2]:
        return None
    order, parts = directories(found[2])
    where, tag = FIELDS[name]
    entry = next((e for e in parts[where].entries if e.tag == tag), None) if where in parts else None
    return None if entry is None else (order, entry)


def field_text(data: bytes, name: str) -> str | None:
    """A text field; null where it is missing or damaged."""
    try:
        found = _field(data, name)
    except DamagedExif:
        return None
    if found is None:
        return None
    return user_comment(found[1].value) if name == "UserComment" else found[1].value.rstrip(b"\0").decode("utf-8", "ignore")


def comment_of(text: str, order: bytes) -> bytes:
    """A user comment: ASCII where its text is, else UTF-16 in the block's byte order, or UTF-8 where readers that go by NULs need it."""
    if text.isascii():
        return b"ASCII\0\0\0" + text.encode()
    wide = b"UNICODE\0" + text.encode("utf-16be" if order == b"MM" else "utf-16le", "surrogatepass")
    return wide if user_comment(wide) == text else b"UNICODE\0" + text.encode()


def with_field(data: bytes, name: str, text: str | None) -> bytes:
    """The file with a text field set, or left out for None; damaged blocks and other files stay as they are.

    A JPEG whose segment could not hold it stays as it is.
    """
    try:
        found = located(data)
        if found is None:
            return data
        start, end, tiff = found
        where, tag = FIELDS[name]
        kind, value = (2, None if text is None else text.encode() + b"\0") if name != "UserComment" else (7, None if text is None else comment_of(text, tiff[:2]))
        new = with_value(tiff, where, tag, kind, value)
        return data if new == tiff else replaced(data, start, end, new)
    except DamagedExif:
        return data


def orientation_of(data: bytes) -> int | None:
    try:
        found = located(data)
        if found is None or not found[2]:
            return None
        order, parts = directories(found[2])
    except DamagedExif:
        return None
    entry = next((e for e in parts["first"].entries if e.tag == ORIENTATION and e.kind == 3 and e.count == 1), None)
    return None if entry is None else struct.unpack(order + "H", entry.value)[0]


# ---- columns ----


def exif_state(content: Column) -> Column:
    """``none``, ``sound``, ``damaged`` or ``unknown`` for every file."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else state(x))

    return run(content)


def exif_field(content: Column, name: str) -> Column:
    """One of FIELDS of every file."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else field_text(x, name))

    return run(content)


def orientation(content: Column) -> Column:
    """The EXIF orientation of every file, for ``imaging.upright``."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else orientation_of(x)).astype("Int32")

    return run(content)


def _with_fields(data: bytes | None, wanted) -> bytes | None:
    for name, text in sorted(dict(wanted or {}).items()) if data is not None else ():
        if name in FIELDS:
            data = with_field(data, name, text or None)
    return data


def _replaced(data: bytes | None, name: str, search: str, replacement: str) -> bytes | None:
    text = None if data is None or not search else field_text(data, name)
    return data if text is None or search not in text else with_field(data, name, text.replace(search, replacement))


def with_exif(content: Column, values: Column) -> Column:
    """Files with text fields set from a map of FIELDS; an empty value leaves its field out, other names are not looked at."""

    @F.pandas_udf("binary")
    def run(contents: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([_with_fields(c, m) for c, m in zip(contents, maps, strict=True)], dtype=object)

    return run(content, values)


def replace_in_field(content: Column, name: str, search: str, replacement: str) -> Column:
    """Files with a literal replaced in one text field; those without it stay byte for byte."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _replaced(x, name, search, replacement))

    return run(content)


#: Files that leave ``edited`` at once.
PIECE_ROWS = 500


def edited(content: Column, edits: list[Column | tuple[str, str, str]], read: list[str]) -> Column:
    """The fields ``read`` of every file after ``edits``, as a struct, in one worker.

    An edit is a map of fields to set, as for ``with_exif``, or (field, search,
    replacement), as for ``replace_in_field``. Files go through all edits one by
    one, so that no batch of changed files is held or sent to another worker.
    """
    fixed = [e if isinstance(e, tuple) else None for e in edits]

    def one(data: bytes | None, maps: Iterator) -> tuple:
        for edit in fixed:
            data = _replaced(data, *edit) if edit else _with_fields(data, next(maps))
        return tuple(None if data is None else field_text(data, name) for name in read)

    @F.pandas_udf(", ".join(f"`{name}` string" for name in read))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for contents, *maps in batches:
            for at in range(0, max(len(contents), 1), PIECE_ROWS):
                rows = zip(contents[at : at + PIECE_ROWS], *(m[at : at + PIECE_ROWS] for m in maps), strict=True)
                yield pd.DataFrame([one(data, iter(own)) for data, *own in rows], columns=read, dtype=object)

    return run(content, *(e for e in edits if not isinstance(e, tuple)))


def cleaned(content: Column) -> Column:
    """Files whose EXIF block is damaged without that block; all others as they are."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: without_exif(x) if x is not None and state(x) == "damaged" else x)

    return run(content)
