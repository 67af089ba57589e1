"""Recursive separator splitting, Arrow-batched.

Where a chunk ends depends on every piece before it in the same document, so
the cut itself is a sequential scan; documents are independent of each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE


def pieces_before(text: str, separator: str) -> list[str]:
    """Cut ``text`` in front of every occurrence of ``separator``."""
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def packed(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``, carrying a tail of at most ``overlap``."""
    window, total = deque(), 0
    for piece in pieces:
        if window and total + len(piece) > size:
            yield "".join(window)
            while total > overlap or (total and total + len(piece) > size):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Chunks of about ``size`` characters, cut at the coarsest separator that works."""
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1:]
    chunks, short = [], []

    def flush():
        chunks.extend(c for c in map(str.strip, packed(short, size, overlap)) if c)
        short.clear()

    for piece in pieces_before(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        chunks.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    flush()
    return chunks


#: Texts cut at once: their chunks are Python's only until they are Arrow's.
TEXTS_AT_ONCE = 64


def chunk_lists(texts: pa.Array, size: int, overlap: int, separators: Sequence[str]) -> pa.Array:
    """The chunks of each text, null for a null."""
    kind, cut = pa.list_(pa.string()), []
    for lo in range(0, len(texts), TEXTS_AT_ONCE):
        some = (t.as_py() for t in texts[lo:lo + TEXTS_AT_ONCE])
        cut.append(pa.array([None if t is None else split_text(t, size, overlap, separators) for t in some], kind))
    return pa.concat_arrays(cut) if cut else pa.array([], kind)


def recursive_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     separators: Sequence[str] = CHUNK_SEPARATORS) -> Column:
    """Array of chunks per text."""
    separators = tuple(separators)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return chunk_lists(texts, size, overlap, separators)

    return split(text)
