"""Grouping spelling variants: words that one edit turns into each other.

Permuterm rotations.  A word is marked with a terminator and rotated, so that
everything but one character becomes a prefix: of `xcy` it is `y$x`, with the
edited character c behind it.  Words that differ by a replaced character share
such a prefix; a word from which c is missing has it as a whole rotation.  The
rotations are dealt and sorted by that prefix; a scan finds the ranges of equal
prefixes, each with at most one word that ends there and one word per character
of the alphabet, and says for every word of a range how many others are near
and which is the most frequent.  No pair is written.

A deletion within a run of equal characters gives the same word wherever it
falls; only the run's first character counts, so no neighbour counts twice.

Words are numbered by falling count, then code points, so the smallest number
among a word's neighbours is the most frequent one.  Forms point to ever
smaller numbers; pointers are doubled until none moves.

Prefixes of more than LONG symbols, which long words have, are replaced by
hashes of both their sides (122 bits), made in one pass over the word.

Edge cases: a null text has no words; equal rows count as often as they occur;
the runs of a row without id are hashed after an empty id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm.storage import settled

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A run loses a character if its hash is a multiple of this.
SPOILT = 97
#: A neighbour is a word's form if it is so many times as frequent.
FORM_TIMES = 2
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 100_000
#: Symbols of a prefix beyond which its hash stands for it.
LONG = 64
MARK = "$"

#: Latin-1 bytes of A-Z, a-z and U+00C0 to U+00FF, the former as lower case; the rest separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spoilt_words(doc_id: object, text: str) -> dict[bytes, int]:
    """Runs of letters of a text as Latin-1, with their count; some lose a character, by a hash of id and run."""
    runs = Counter(text.encode("latin-1", "replace").translate(LETTERS).split(b" "))
    runs.pop(b"", None)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: dict[bytes, int] = {}
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % SPOILT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_CHARS:
            out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words of enough characters and occurrences."""

    def batch_of(seen: Counter[bytes]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in seen], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in spoilt_words(doc_id, text.as_py() or "").items():
                    seen[word] += n
                if len(seen) >= COUNTED_WORDS:
                    yield batch_of(seen)
                    seen.clear()
        yield batch_of(seen)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = narrow.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """word, n and number: rising with falling n, then with the word's code points.

    The numbers follow the partitions of the sort and are fixed once written.
    """
    ranked = words.orderBy(F.desc("n"), "word").withColumn("number", F.monotonically_increasing_id())
    return settled(ranked, "words")


ROTATION = "prefix string, number long, whole boolean, first boolean"


def short_rotations(words: DataFrame) -> DataFrame:
    """The prefixes of at most LONG symbols.

    `whole`: the rotation ends with the prefix; else one character follows that
    is skipped, and `first` says that it begins a run of equal characters.
    """
    word, at = F.col("word"), F.col("at")
    size = F.length(word)
    spots = words.where(size <= LONG).select("*", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    before = F.substr(word, F.lit(1), at)
    whole = spots.where(size < LONG).select(
        F.concat(F.substr(word, at + 1), F.lit(MARK), before).alias("prefix"), "number", F.lit(True).alias("whole"), F.lit(True).alias("first")
    )
    here, last = F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1))
    skipped = spots.where(at < size).select(
        F.concat(F.substr(word, at + 2), F.lit(MARK), before).alias("prefix"), "number", F.lit(False).alias("whole"),
        ((at == 0) | (here != last)).alias("first"),
    )
    return whole.unionByName(skipped)


PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)


def side_hashes(word: str, base: int) -> tuple[list[int], list[int]]:
    """Polynomial hashes of all beginnings, and of all endings, of a word."""
    codes = [ord(c) + 1 for c in word]
    heads, tails, power = [0], [0], 1
    for code in codes:
        heads.append((heads[-1] * base + code) % PRIME)
    for code in reversed(codes):
        tails.append((code * power + tails[-1]) % PRIME)
        power = power * base % PRIME
    return heads, tails[::-1]


def long_rotations(words: DataFrame) -> DataFrame:
    """The prefixes of more than LONG symbols, as hashes of both sides with their lengths."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, number in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                word = word.as_py()
                sides, size = [side_hashes(word, base) for base in BASES], len(word)
                rows = []
                for skip in (0, 1):
                    if size + 1 - skip > LONG:
                        for at in range(size + 1 - skip):
                            hashes = " ".join(f"{tails[at + skip]:x} {heads[at]:x}" for heads, tails in sides)
                            first = not skip or at == 0 or word[at] != word[at - 1]
                            rows.append((f"{MARK}{size - at - skip} {at} {hashes}", number, not skip, first))
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pydict(dict(zip(("prefix", "number", "whole", "first"), zip(*rows[lo : lo + 10_000]))))

    return words.where(F.length("word") >= LONG).select("word", "number").mapInArrow(rotate, ROTATION)


NONE = np.iinfo(np.int64).max


def scanned(prefix: pa.Array, number: np.ndarray, whole: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number, how many are near and the smallest near number of every word with neighbours, range by range.

    Ranges are stretches of equal prefixes.  Skipping words are near each other,
    and near the whole one if they skip the first of a run.
    """
    n = len(number)
    change = np.ones(n, dtype=bool)
    change[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(change)
    range_of = np.cumsum(change) - 1

    def least(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(where, values, NONE), start)

    def times(where: np.ndarray) -> np.ndarray:
        return np.add.reduceat(where.astype(np.int64), start)

    skipping, reach = ~whole, ~whole & first
    low = least(number, skipping)
    second = least(number, skipping & (number != low[range_of]))
    end, n_end = least(number, whole), times(whole)
    beside = np.where(number == low[range_of], second[range_of], low[range_of])
    beside = np.where(first, np.minimum(beside, end[range_of]), beside)
    near = np.where(whole, times(reach)[range_of], times(skipping)[range_of] - 1 + first * n_end[range_of])
    best = np.where(whole, least(number, reach)[range_of], beside)
    some = near > 0
    return number[some], near[some], best[some]


def neighbours(words: DataFrame) -> DataFrame:
    """number, n_near and best (the smallest near number) of every word with a near one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            # The last range may go on in the next batch.
            prefix = table.column("prefix").combine_chunks()
            same = pc.equal(prefix, prefix[-1]).to_numpy(zero_copy_only=False) if len(prefix) else np.zeros(0, bool)
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            yield from found(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from found(rest)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            prefix = table.column("prefix").combine_chunks()
            columns = [table.column(c).to_numpy() for c in ("number", "whole", "first")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in scanned(prefix, *columns)], names=["number", "near", "best"])

    rows = short_rotations(words).unionByName(long_rotations(words))
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix")
    said = dealt.mapInArrow(scan, "number long, near long, best long")
    return said.groupBy("number").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """number and root of every word that has a form (number, up).

    Pointers are doubled, so rounds grow with the logarithm of the longest way.
    """
    ways = settled(forms.select("number", "up", F.lit(True).alias("moved")), "forms")
    while ways.where("moved").limit(1).count():
        above = ways.select(F.col("number").alias("up"), F.col("up").alias("above"))
        joined = ways.join(above, "up", "left")
        ways = settled(
            joined.select("number", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "forms"
        )
    return ways.select("number", F.col("up").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = numbered(word_counts(docs))
    near = settled(neighbours(words), "neighbours")
    others = words.select(F.col("number").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    rows = words.join(near, "number", "left").join(others, "best", "left")
    has_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    rows = settled(
        rows.select(
            "number", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best")).alias("up"),
            F.when(has_form, F.col("best_word")).alias("form"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    last = roots(rows.where("up IS NOT NULL").select("number", "up"))
    named = last.join(words.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root")
    joined = rows.join(named.select("number", "root_word"), "number", "left")
    return joined.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
