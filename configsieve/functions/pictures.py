"""Format and size of a picture from its first bytes, and whether a PNG shows anything."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

PNG_START = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of the PNG colour types.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced PNG.
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bytes that are unpacked at a time.
UNPACKED = 1 << 16

UNKNOWN = (None, None, None)
MAX_SIDE = 2**31 - 1


def picture_header(content: bytes | None) -> tuple[str | None, int | None, int | None]:
    """``(format, width, height)`` of PNG, GIF, BMP and JPEG pictures; sizes beyond an INT are none."""
    kind, width, height = stated_header(content) if content else UNKNOWN
    believable = width is not None and 0 <= width <= MAX_SIDE and 0 <= height <= MAX_SIDE
    return (kind, width, height) if believable else (kind, None, None)


def stated_header(content: bytes) -> tuple[str | None, int | None, int | None]:
    """What the header says."""
    try:
        if content[:8] == PNG_START:
            return ("png", *struct.unpack(">II", content[16:24]))
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", content[6:10]))
        if content[:2] == b"BM":
            width, height = struct.unpack("<ii", content[18:26])
            return "bmp", width, abs(height)
        if content[:3] == b"\xff\xd8\xff":
            return jpeg_header(content)
    except struct.error:
        pass
    return UNKNOWN


def jpeg_header(content: bytes) -> tuple[str, int | None, int | None]:
    """Walk the JPEG segments to the frame header."""
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            break
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5:at + 9])
            return "jpeg", width, height
        at += 2 + struct.unpack(">H", content[at + 2:at + 4])[0]
    return "jpeg", None, None


def shows_something(content: bytes | None) -> bool:
    """Whether a PNG has a sample that is not zero; pictures of other formats are taken to.

    Rows are stored as differences to their neighbours, which are all zero where
    the samples are, so nothing has to be decoded: the unpacked bytes are looked
    at piece by piece, up to the first that is not zero and tells no row's
    filter.  A PNG that breaks off before shows nothing.
    """
    if content is None or content[:8] != PNG_START:
        return content is not None
    try:
        width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
        samples = PNG_SAMPLES[colour]
    except (struct.error, KeyError):
        return False
    passes = PNG_PASSES if interlaced else ((0, 0, 1, 1),)
    at, ends = 0, []
    for left, top, step_x, step_y in passes:
        columns, rows = -(-(width - left) // step_x), -(-(height - top) // step_y)
        if columns > 0 and rows > 0:
            row = 1 + -(-columns * samples * bits // 8)
            ends.append((at, at + rows * row, row))
            at += rows * row
    place = 0
    for piece in unpacked(content):
        found = np.flatnonzero(np.frombuffer(piece, np.uint8)) + place
        for start, end, row in ends:
            own = found[(found >= start) & (found < end)]
            if ((own - start) % row != 0).any():
                return True
        place += len(piece)
        if place >= at:
            break
    return False


def unpacked(content: bytes) -> Iterator[bytes]:
    """The picture data of a PNG in pieces; it ends early where the data is broken."""
    at, inflate = 8, zlib.decompressobj()
    while at + 8 <= len(content):
        length, kind = struct.unpack(">I4s", content[at:at + 8])
        data = content[at + 8:at + 8 + length] if kind == b"IDAT" else b""
        while data:
            try:
                piece = inflate.decompress(data, UNPACKED)
            except zlib.error:
                return
            if piece:
                yield piece
            data = inflate.unconsumed_tail
        at += 12 + length
