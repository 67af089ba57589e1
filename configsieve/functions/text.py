"""Scalar expressions over document and section text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ASSIGNMENT_PATTERNS,
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DEFAULT_SECTION_TYPE,
    RELATION_TERMS,
    SECTION_KEYWORDS,
)
from .regex import any_chars, strip, to_java

HEADING_LINES = 3
HEADING_MAX_LENGTH = 100


def doc_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def section_type(content: Column, keywords=SECTION_KEYWORDS, default: str = DEFAULT_SECTION_TYPE) -> Column:
    """The first class one of whose keywords occurs in the lower-cased content."""
    lowered = F.lower(content)
    classes = [F.when(_contains_any(lowered, words), F.lit(name)) for name, words in keywords]
    return F.coalesce(*classes, F.lit(default))


def heading(content: Column) -> Column:
    """The first of the leading lines that looks like ``Some title:``, without its colons."""
    lines = F.split(content, "\n", HEADING_LINES + 1)
    candidates = []
    for i in range(HEADING_LINES):
        line = strip(F.get(lines, F.lit(i)))
        looks_right = F.endswith(line, F.lit(":")) & (F.length(line) < HEADING_MAX_LENGTH)
        candidates.append(F.when(looks_right, F.btrim(line, F.lit(":"))))
    return F.coalesce(*candidates)


def has_assignment(content: Column, patterns: Sequence[str] = ASSIGNMENT_PATTERNS) -> Column:
    """Whether one of the assignment patterns (``setting = ...``) occurs."""
    matches = [F.rlike(content, F.lit(to_java(p))) for p in patterns]
    return F.when(F.contains(content, F.lit("=")), reduce(or_, matches)).otherwise(F.lit(False))


def term_mask(content: Column, terms: Sequence[str] = RELATION_TERMS) -> Column:
    """Bit i is set when term i occurs in the lower-cased content."""
    lowered = F.lower(content)
    bits = [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(terms)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the last.

    One regex pass: consume a step, capture a window by lookahead.  A tail no
    longer than the overlap is already inside the previous window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than size")
    step = size - overlap
    more_than_overlap = f"(?:\\A|(?={any_chars(overlap + 1, overlap + 1)}))"
    window = f"{more_than_overlap}(?=({any_chars(1, size)})){any_chars(1, step)}"
    return F.regexp_extract_all(text, F.lit(window), F.lit(1))


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])
