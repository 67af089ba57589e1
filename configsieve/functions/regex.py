"""Python-flavoured patterns as Java regexes, and match arrays from them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.isspace() accepts.  Java's \s is ASCII only and its
# Unicode mode leaves out U+001C..U+001F.  The non-Latin ones sit behind a
# range test so that an ordinary character is rejected after two checks.
PY_SPACE = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
PY_CLASSES = {r"\s": PY_SPACE, r"\d": r"\p{Nd}", r"\w": r"\p{L}\p{N}_"}
STRIP_PATTERN = rf"^[{PY_SPACE}]+|[{PY_SPACE}]+\z"

# Matches nothing; a literal beyond the BMP anywhere after a lookbehind makes Java
# step back by code points instead of UTF-16 units.
BY_CODE_POINTS = chr(0x10FFFF) + "{0}"

# Control characters, then noncharacters that Unicode reserves for internal use.
PAD_CHARS = (*map(chr, range(8)), *map(chr, range(0xFDD0, 0xFDF0)))

# The private-use planes, tried when a text holds all of these.
PRIVATE_USE = ((0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))

# Letters beyond upper and lower case that a case-insensitive i or s matches.
ODD_LETTERS = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}

IGNORE_CASE = "(?i)"
JAVA_IGNORE_CASE = "(?iu)"

# Anchors and lookarounds look at characters outside the match, which the
# single-scan form pads and the per-match form does not have; back-references
# and named groups would need other numbers or spelling there.
CHARACTER_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]")
UNSUITABLE = re.compile(r"\\[AbBGzZ1-9]|\(\?(?:<?[=!]|P)|(?<!\\)[\^$]")


def to_java(pattern: str) -> str:
    """The same pattern with Python's Unicode classes and case rules, for Java."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if pair.lower() in PY_CLASSES:
            body = PY_CLASSES[pair.lower()]
            negated = pair[1].isupper()
            out.append(f"[^{body}]" if negated else body if in_class else f"[{body}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            i += 1
    return "".join(out).replace(IGNORE_CASE, JAVA_IGNORE_CASE)


def without_captures(pattern: str) -> str:
    """The pattern with every capturing group made non-capturing."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        in_class = char == "[" or (in_class and char != "]")
        opens_group = char == "(" and not in_class and pattern[i + 1:i + 2] != "?"
        out.append("(?:" if opens_group else char)
        i += 1
    return "".join(out)


def check_pattern(pattern: str) -> None:
    """Reject patterns whose matches cannot be located or re-read on their own."""
    compiled = re.compile(pattern)
    if compiled.match(""):
        raise ValueError(f"pattern may match the empty string: {pattern}")
    if compiled.groups not in (1, 2):
        raise ValueError(f"pattern needs one or two groups: {pattern}")
    if UNSUITABLE.search(CHARACTER_CLASS.sub("", pattern)):
        raise ValueError(f"anchors, lookarounds, references and named groups need engine='arrow': {pattern}")


def find_all(text: Column, pattern: str, group: int = 0, not_after: str | None = None,
             guard: Column | None = None) -> Column:
    """One group of every match in ``text``; null where ``guard`` does not hold."""
    java = _guarded(to_java(pattern), not_after)
    return _where(guard, F.regexp_extract_all(text, F.lit(java), F.lit(group)))


def folded(text: Column) -> Column:
    """Lower case, with the letters that ``(?i)`` takes for ``i`` and ``s`` replaced.

    Null for texts that hold neither ``=`` nor ``://``.
    """
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in ODD_LETTERS])
    plain = F.when(odd, F.translate(text, "".join(ODD_LETTERS), "".join(ODD_LETTERS.values()))).otherwise(text)
    return F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit("://")), F.lower(plain))


def may_match(text: Column, folded_text: Column, needs: str | None, words: Sequence[str]) -> Column | None:
    """Whether a text holds the literal and one of the words a match must contain."""
    if needs not in ("=", "://"):
        # ``folded`` is only there for texts with one of these.
        return None if needs is None else F.contains(text, F.lit(needs))
    guard = F.contains(text, F.lit(needs))
    if words:
        guard = guard & reduce(or_, [F.contains(folded_text, F.lit(w)) for w in words])
    return guard


def any_chars(least: int, most: int) -> str:
    """That many characters of any kind; dot-all is far faster in Java than ``[\\s\\S]``."""
    return f"(?s:.{{{least},{most}}})"


def pad_char(text: Column) -> Column:
    """A character ``text`` does not contain: a short list is tried first, then every private-use one.

    A text with all of these (some 131,000) is refused with an error rather than skipped.
    """
    free = [F.when(~F.contains(text, F.lit(c)), F.lit(c)) for c in PAD_CHARS]
    points = F.concat(*[F.sequence(F.lit(low), F.lit(high)) for low, high in PRIVATE_USE])
    rare = F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    unused = F.get(F.array_except(rare, F.split(text, "")), F.lit(0))
    refused = F.raise_error(F.lit("a text holds every private-use character; none is left to pad it with"))
    return F.coalesce(*free, unused, refused.cast("string"))


def padded(text: Column, width: int) -> Column:
    """``text`` behind ``width`` pad characters, for :func:`find_all_in_context`."""
    return F.concat(F.repeat(pad_char(text), F.lit(width)), text)


def find_all_in_context(padded_text: Column, pattern: str, width: int,
                        not_after: str | None = None, guard: Column | None = None) -> Column:
    """Every match with ``width`` characters before it and up to ``width`` after it.

    Spark does not expose match offsets, and recovering them with a fold over
    the pieces is quadratic in the matches of a text.  Here one regex scan does
    it: at each match a fixed-length lookbehind steps back ``width`` characters
    and captures neighbourhood and match as one piece.  The padding makes the
    fixed length available at the start of the text as well, and the same
    lookbehind keeps matches out of the padding.
    """
    bare = _guarded(without_captures(to_java(pattern)), not_after)
    around = f"{any_chars(width, width)}{bare}{any_chars(0, width)}"
    scan = f"(?={bare})(?<=(?=({around})){any_chars(width, width)}){bare}{BY_CODE_POINTS}"
    found = F.regexp_extract_all(padded_text, F.lit(scan), F.lit(1))
    return _where(guard, found)


def strip(text: Column) -> Column:
    """Python's ``str.strip()``; Spark's ``trim`` removes spaces only."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def _guarded(java: str, not_after: str | None) -> str:
    return java if not_after is None else f"(?<![{not_after}]){java}"


def _where(guard: Column | None, found: Column) -> Column:
    """Skip the scan where the guard fails (null explodes to no row)."""
    return found if guard is None else F.when(guard, found)
