"""Counts over one whole text, on its UTF-8 bytes.

Words are runs of characters other than ASCII white space, which is what
`bytes.split` separates by.
"""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that do not begin a character.
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)


def without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def count_of(data: bytes, kinds: bytes) -> int:
    return len(data) - without(data, kinds)


def word_chars(data: bytes) -> int:
    """Characters (code points) in words."""
    return without(data, SPACE + CONTINUATION)


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    filled = [line for line in lines if line.strip(SPACE)]
    return len(filled) - len(set(filled))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 2_000_000:  # keep pair * words below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    found, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(found) == len(windows):
        return 0
    again = times[back] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())
