"""Metadata inside image and tensor files: small binary parsers behind Arrow-batched functions.

A parser sees one file's bytes; Spark divides the files. Broken files give
nulls, never an error.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import last_of_keys

PNG = b"\x89PNG\r\n\x1a\n"
#: Share of NUL bytes from which a comment is taken for UTF-16.
NUL_SHARE = 0.20


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, content) of the chunks that are whole."""
    at = len(PNG) if data.startswith(PNG) else len(data)
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def png_text(data: bytes) -> dict[str, str]:
    """Text chunks of a PNG; of repeated keys the last counts."""
    found = {}
    for kind, content in png_chunks(data):
        key, zero, rest = content.partition(b"\0")
        if kind not in (b"tEXt", b"zTXt", b"iTXt") or not key or not zero:
            continue
        text: str | None = None
        if kind == b"tEXt":
            text = rest.decode("latin-1")
        elif kind == b"zTXt" and rest[:1] == b"\0":
            raw = _inflated(rest[1:])
            text = raw.decode("latin-1") if raw is not None else None
        elif kind == b"iTXt" and len(rest) >= 2:
            packed, tail = rest[0], rest[2:].split(b"\0", 2)
            raw = (_inflated(tail[2]) if packed else tail[2]) if len(tail) == 3 else None
            text = raw.decode("utf-8", "ignore") if raw is not None else None
        if text is not None:
            found[key.decode("latin-1")] = text
    return found


def png_with_text(data: bytes, values: dict[str, str | None]) -> bytes:
    """The PNG with text chunks of these keys (in any case) replaced, before its end; None deletes a key.

    Text beyond Latin-1 goes into an international chunk.
    """
    gone = {k.lower().encode("latin-1", "ignore") for k in values}
    chunk = lambda kind, content: len(content).to_bytes(4, "big") + kind + content + zlib.crc32(kind + content).to_bytes(4, "big")
    out = [PNG]
    for kind, content in png_chunks(data):
        if kind in (b"tEXt", b"zTXt", b"iTXt") and content.partition(b"\0")[0].lower() in gone:
            continue
        if kind == b"IEND":
            for k, v in values.items():
                if v is not None:
                    key, text = k.encode("latin-1", "ignore"), v.replace("\0", "")
                    plain = all(c <= "\xff" for c in text)
                    out.append(chunk(b"tEXt", key + b"\0" + text.encode("latin-1")) if plain else chunk(b"iTXt", key + b"\0\0\0\0\0" + text.encode()))
        out.append(chunk(kind, content))
    return b"".join(out) if len(out) > 1 else data


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from a header."""
    if data[:8] == PNG and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "WEBP", w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if data[:2] == b"\xff\xd8":
        for marker, content in jpeg_segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(content) >= 5:
                h, w = struct.unpack(">HH", content[1:5])
                return "JPEG", w, h
    return None


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):
            return
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + n]
        at += 2 + n


def _utf16(data: bytes) -> str | None:
    """UTF-16 text by its mark, else by the side that has more NULs, else by the more ASCII reading."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "ignore").replace("\0", "")
    pairs = len(data) // 2
    if not pairs:
        return None
    high, low = data[1 : 2 * pairs : 2].count(0), data[0 : 2 * pairs : 2].count(0)
    read = {k: data.decode(k, "ignore").replace("\0", "") for k in ("utf-16le", "utf-16be")}
    if high != low:
        return read["utf-16le" if high > low else "utf-16be"]
    ascii_share = lambda s: sum(c in "\n\r\t" or " " <= c <= "~" for c in s) / len(s) if s else 0.0
    return max(read.values(), key=lambda s: (ascii_share(s), s))


def user_comment(raw: bytes) -> str:
    """An EXIF user comment in whatever encoding its eight-byte head and its NULs suggest."""
    head, body = raw[:8], raw[8:]
    share = body.count(0) / len(body) if body else 0.0
    plain = lambda kind, data: data.decode(kind, "ignore").replace("\0", "")
    if head == b"ASCII\0\0\0":
        wide = _utf16(body) if share >= NUL_SHARE else None
        return wide if wide is not None else plain("ascii", body)
    if head == b"UNICODE\0":
        wide = _utf16(body) if share >= NUL_SHARE else None
        return wide if wide is not None else plain("utf-8", body)
    if head == b"JIS\0\0\0\0\0"[:8]:
        wide = _utf16(body)
        return wide if wide is not None else plain("shift_jis", body)
    wide = _utf16(raw)
    return wide if wide is not None else plain("utf-8", raw)


def _tiff(data: bytes) -> dict[int, bytes]:
    """Raw values of the tags of the first and the EXIF directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    found: dict[int, bytes] = {}
    if order is None or len(data) < 8:
        return found
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = sizes.get(kind, 0) * count
            (place,) = struct.unpack(order + "I", entry[8:])
            if tag == 0x8769:
                todo.append(place)
            elif size:
                found[tag] = entry[8 : 8 + size] if size <= 4 else data[place : place + size]
    return found


def exif_text(data: bytes) -> dict[str, str]:
    """parameters (user comment, else description, else JPEG comment), Software and order_in_post of a JPEG or WebP."""
    tiff, comment = b"", None
    if data[:2] == b"\xff\xd8":
        for marker, content in jpeg_segments(data):
            if marker == 0xE1 and content[:6] == b"Exif\0\0":
                tiff = content[6:]
            elif marker == 0xFE:
                comment = content.decode("utf-8", "ignore")
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                tiff = data[at + 8 : at + 8 + n].removeprefix(b"Exif\0\0")
            at += 8 + n + n % 2
    tags = _tiff(tiff)
    plain = lambda tag: tags[tag].rstrip(b"\0").decode("utf-8", "ignore") if tag in tags else None
    values = {"parameters": (user_comment(tags[0x9286]) if 0x9286 in tags else None) or plain(0x010E) or comment, "Software": plain(0x0131)}
    return {k: v for k, v in values.items() if v}


def jpeg_with_comment(data: bytes, text: str | None, software: str | None = None) -> bytes:
    """The JPEG with an EXIF block of its own: the text as a user comment in UTF-16 and the software; None for both removes the block."""
    if data[:2] != b"\xff\xd8":
        return data
    out, at = [data[:2]], 2
    comment = b"UNICODE\0" + text.encode("utf-16le") if text is not None else b""
    maker = software.encode() + b"\0" if software is not None else b""
    if comment or maker:
        # a first directory with software and a pointer, then the EXIF directory with the comment, then the values
        entries = [(0x0131, 2, maker)] if maker else []
        second = 8 + 2 + 12 * (len(entries) + bool(comment)) + 4
        values = second + (2 + 12 + 4 if comment else 0)
        first = struct.pack("<H", len(entries) + bool(comment))
        for tag, kind, value in entries:
            first += struct.pack("<HHI", tag, kind, len(value)) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", values))
        if comment:
            first += struct.pack("<HHII", 0x8769, 4, 1, second)
        body = first + bytes(4)
        held = maker if len(maker) > 4 else b""
        if comment:
            body += struct.pack("<H", 1) + struct.pack("<HHII", 0x9286, 7, len(comment), values + len(held)) + bytes(4)
        block = b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + body + held + comment
        out.append(b"\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at : at + 2 + n]
        if not (part[1] == 0xE1 and part[4:10] == b"Exif\0\0"):
            out.append(part)
        at += 2 + n
    return b"".join([*out, data[at:]])


def embedded(data: bytes) -> dict[str, str]:
    return png_text(data) if data[:8] == PNG else exif_text(data)


def tensor_header(data: bytes) -> str | None:
    """The JSON header of a tensor file: eight bytes of length, then the header; null if it is broken."""
    if len(data) < 8:
        return None
    n = int.from_bytes(data[:8], "little")
    try:
        head = data[8 : 8 + n].decode()
        return head if len(data) >= 8 + n and isinstance(json.loads(head), dict) else None
    except ValueError:
        return None


def tensor_with_metadata(data: bytes, metadata: dict[str, str]) -> bytes:
    """The tensor file with other metadata; tensors, offsets and body stay byte for byte. Empty metadata is left out."""
    head = tensor_header(data)
    if head is None:
        return data
    fields = {k: v for k, v in json.loads(head).items() if k != "__metadata__"}
    new = json.dumps(({"__metadata__": metadata} if metadata else {}) | fields, separators=(",", ":")).encode()
    new += b" " * (-len(new) % 8)
    return len(new).to_bytes(8, "little") + new + data[8 + int.from_bytes(data[:8], "little") :]


def _batched(f: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda x: f(x) if x is not None else None)

    return run


def text_map(content: Column) -> Column:
    """Embedded text of an image as a map."""
    return _batched(embedded, "map<string,string>")(content)


def dimensions(content: Column) -> Column:
    """format, width, height of an image header; null fields if unknown. Pass the first 64 KB at least."""

    @F.pandas_udf("format string, width int, height int")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(x is not None and size_of(x)) or (None, None, None) for x in content], columns=["format", "width", "height"])

    return run(content)


#: The tensors of a header.
TENSORS = "map<string, struct<dtype: string, shape: array<bigint>, data_offsets: array<bigint>>>"


def tensors(content: Column) -> Column:
    """metadata and tensors of a tensor file's header."""
    head = _batched(tensor_header, "string")(content)
    every = F.from_json(head, TENSORS)
    meta = F.from_json(F.get_json_object(head, "$.__metadata__"), "map<string,string>")
    return F.struct(meta.alias("metadata"), F.map_filter(every, lambda k, _: k != "__metadata__").alias("tensors"))


def with_text(content: Column, *values: Column) -> Column:
    """PNG bytes with text chunks set from one map after another; an empty value deletes its key. All maps are worked off in one Python process."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, *values: pd.Series) -> pd.Series:
        def changed(data: bytes, maps: tuple) -> bytes:
            for m in maps:
                data = png_with_text(data, {k: v or None for k, v in dict(m or {}).items()})
            return data

        return pd.Series([None if c is None else changed(c, maps) for c, *maps in zip(content, *values, strict=True)])

    return run(content, *values)


def with_tensor_metadata(content: Column, metadata: Column) -> Column:
    """Tensor file bytes with other metadata."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, metadata: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else tensor_with_metadata(c, dict(m or {})) for c, m in zip(content, metadata, strict=True)])

    return run(content, metadata)


def merge_metadata(old: Column, new: Column, kept: list[str] = (), cleared: bool = False) -> Column:
    """Metadata with new values over old ones; cleared of all others but ``kept`` if asked. Empty values delete their key."""
    base = F.map_filter(old, lambda k, _: k.isin(list(kept))) if cleared and kept else (F.expr("map()").cast("map<string,string>") if cleared else old)
    under = F.map_filter(F.coalesce(base, F.expr("map()").cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(under, F.map_filter(new, lambda _, v: v != ""))


def key_values(text: Column) -> Column:
    """``key=value`` lines as a map; a value that is JSON stays JSON text, the last of repeated keys counts."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substr(x, F.position(F.lit("="), x) + 1)).alias("value")))
    return F.map_from_entries(last_of_keys(pairs))
