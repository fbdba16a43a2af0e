"""Format, width and height of an image from its header; nothing is decoded."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a file that are looked at first; the rest only where a header is not found in them.
START = 1 << 16
#: Fixed value: an image of more pixels counts as broken.
MOST_PIXELS = 178_956_970


def _unsigned(c: bytes, at: int, size: int, little: bool = False) -> int | None:
    """The unsigned number in `size` bytes from offset `at`; None beyond the end."""
    return int.from_bytes(c[at : at + size], "little" if little else "big") if len(c) >= at + size else None


def _png(c: bytes):
    """The first chunk must be the header, with its right checksum."""
    if c[12:16] == b"IHDR" and zlib.crc32(c[12:29]) == _unsigned(c, 29, 4):
        return _unsigned(c, 16, 4), _unsigned(c, 20, 4)


def _gif(c: bytes):
    return _unsigned(c, 6, 2, True), _unsigned(c, 8, 2, True)


def _bmp(c: bytes):
    if _unsigned(c, 14, 4, True) == 12:
        return _unsigned(c, 18, 2, True), _unsigned(c, 20, 2, True)
    height = _unsigned(c, 22, 4, True)  # rows may go downwards
    return _unsigned(c, 18, 4, True), height if height is None or height < 1 << 31 else (1 << 32) - height


def _webp(c: bytes):
    kind = c[12:16]
    if kind == b"VP8 " and c[23:26] == b"\x9d\x01\x2a" and len(c) >= 30:
        return _unsigned(c, 26, 2, True) & 0x3FFF, _unsigned(c, 28, 2, True) & 0x3FFF
    if kind == b"VP8L" and c[20:21] == b"\x2f" and len(c) >= 25:
        bits = _unsigned(c, 21, 4, True)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(c) >= 30:
        return _unsigned(c, 24, 3, True) + 1, _unsigned(c, 27, 3, True) + 1


def _jpeg(c: bytes):
    """Walks from segment to segment to the frame header (markers C0 to CF without C4, C8 and CC)."""
    at = 2
    while at + 1 < len(c) and c[at] == 0xFF:
        marker = c[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return _unsigned(c, at + 7, 2), _unsigned(c, at + 5, 2)
        elif marker in (0x00, 0xD9, 0xDA) or (_unsigned(c, at + 2, 2) or 0) < 2:
            return None
        else:
            at += 2 + _unsigned(c, at + 2, 2)
    return None


def _tiff(c: bytes, little: bool):
    """Width (tag 256) and height (tag 257) of the first directory, as two- or four-byte numbers."""
    first = _unsigned(c, 4, 4, little)
    count = None if first is None else _unsigned(c, first, 2, little)
    found: dict[int, int | None] = {}
    for at in range(first + 2, min(first + 2 + 12 * count, len(c)), 12) if count else ():
        tag = _unsigned(c, at, 2, little)
        if tag in (256, 257) and tag not in found:
            found[tag] = _unsigned(c, at + 8, 2 if _unsigned(c, at + 2, 2, little) == 3 else 4, little)
            if len(found) == 2:
                break
    return found.get(256), found.get(257)


_FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "png", _png), (b"\xff\xd8\xff", "jpeg", _jpeg), (b"GIF87a", "gif", _gif), (b"GIF89a", "gif", _gif), (b"BM", "bmp", _bmp),
    (b"RIFF", "webp", lambda c: _webp(c) if c[8:12] == b"WEBP" else None), (b"II*\0", "tiff", lambda c: _tiff(c, True)), (b"MM\0*", "tiff", lambda c: _tiff(c, False)),
)


def _parsed(c: bytes | None) -> dict | None:
    for start, name, parse in _FORMATS:
        if c is not None and c.startswith(start):
            width, height = parse(c) or (None, None)
            if width and height and width * height <= MOST_PIXELS:
                return {"format": name, "width": width, "height": height}
    return None


def header(content: Column) -> Column:
    """Struct of format, width and height of an image file's bytes; null if they are no whole header of a known format.

    Known: png, jpeg, gif, bmp, webp, tiff. A null or empty file, a header that is cut off or has a wrong
    checksum, a size of zero and over MOST_PIXELS pixels give null. Of a long file the first START bytes are
    looked at, and all of it only where they have no whole header.
    """

    @F.arrow_udf("format string, width int, height int")
    def parse(files: pa.Array) -> pa.Array:
        kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
        return pa.array([_parsed(c) for c in files.to_pylist()], kind)

    found = parse(F.substring(content, 1, START))
    return F.coalesce(found, parse(F.when(found.isNull() & (F.octet_length(content) > START), content)))
