"""YAML blocks of a text: found in the JVM, parsed in Arrow batches by a Python library.

``YAML_BLOCK`` as it stands tries every line of a stretch of white space anew and
is quadratic in its length.  :func:`linear_scan` finds the same blocks in one
pass: it looks at a stretch once, from its first character, and never goes back
into what it has taken.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONTEXT_CHARS, YAML_BLOCK
from .regex import PY_SPACE, find_all_in_context, pad_char, padded

# A line that ends in ``name:``; texts without one hold no block.
OPENING_LINE = rf"[A-Za-z0-9_]:[{PY_SPACE}]*\n"

BLOCKS_TYPE = "array<struct<json: string, context: string>>"

# Lines of ``name:`` or ``name: words`` that are not deep: what both of PyYAML's
# parsers read alike.  The one in C is several times faster, but differs on
# nesting beyond Python's recursion limit and on some odd characters.
PLAIN_BLOCK = re.compile(r"\n*(?: {0,64}[A-Za-z_][A-Za-z0-9_]{0,99}:(?: {1,9}[A-Za-z0-9][A-Za-z0-9_./ -]*)?\n)+")
FAST_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def parse_block(block: str):
    """The mapping a block spells out, or None."""
    try:
        value = yaml.load(block, FAST_LOADER if PLAIN_BLOCK.fullmatch(block) else yaml.SafeLoader)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_text(value) -> str | None:
    """JSON text of a YAML value; dates become ISO text, odd keys their ``str``."""
    for form in (lambda: value, lambda: plain(value)):
        try:
            return json.dumps(form(), default=str, allow_nan=False)
        except (TypeError, ValueError, RecursionError):
            continue
    return None


def plain(value):
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, bool, type(None))) else str(value)


BLANK = PY_SPACE.replace(r"\n", "", 1)


def linear_scan(width: int) -> str:
    """``YAML_BLOCK`` for a text behind ``width`` pad characters, as a Java pattern without backtracking.

    A block begins with the first line that starts in a stretch of white space:
    at the text's start, at the end of the block before, or behind the line feed
    of the line that the stretch begins on.  That line's rest is then part of
    what is found (see :func:`block_start`).

    After the opening line, white space has to follow its line feed; each stretch
    of it takes the line behind along.  Where the text ends before that line
    does, the stretch itself counts up to its last line of two blanks or more.
    """
    start = rf"(?:(?<=\A(?s:.{{{width}}}))|(?<![{PY_SPACE}])[{BLANK}]*+\n|\G)"
    opening = rf"[{PY_SPACE}]*+[A-Za-z_][A-Za-z0-9_]*+:[{BLANK}]*+\n"
    line, tail = rf"[{PY_SPACE}]++[^\n]++\n", rf"[{PY_SPACE}]+[{BLANK}]\n"
    return rf"{start}{opening}(?:{line}(?:{line})*+(?:{tail})?|{tail})"


def block_start(found: str, width: int, pad: str) -> int:
    """Where the block begins in what :func:`linear_scan` found with ``width`` characters before it."""
    before = found[width - 1]
    return width if before == pad or before.isspace() else found.index("\n", width) + 1


def yaml_blocks(text: Column, width: int = CONTEXT_CHARS) -> Column:
    """Array of ``(json, context)``, one per block that parses to a mapping.

    Only blocks and their context go to Python.
    """

    @F.pandas_udf(BLOCKS_TYPE)
    def blocks(found: pd.Series, pads: pd.Series) -> pd.Series:
        block_pattern = re.compile(YAML_BLOCK)

        def of(pieces, pad: str) -> list[dict] | None:
            if pieces is None:
                return None
            out = []
            for piece in pieces:
                at = block_start(piece, width, pad)
                value = parse_block(block_pattern.match(piece[at:]).group())
                if value is not None:
                    out.append({"json": json_text(value), "context": piece[at - width:].lstrip(pad)})
            return out

        return pd.Series([of(*pair) for pair in zip(found, pads)], dtype=object)

    opens = F.rlike(text, F.lit(OPENING_LINE))
    found = find_all_in_context(padded(text, width), linear_scan(width), width, guard=opens)
    return blocks(found, F.when(opens, pad_char(text)))
