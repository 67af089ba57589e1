"""Token counts by byte-pair merging with a heap and a linked list.

A text is a chain of symbols (characters, blanks as U+2581).  The adjacent pair
of the best rank is merged, again and again, until no pair is a piece of the
vocabulary.  The count is the number of symbols at first, minus the merges,
plus what byte fallback adds for characters that are no piece; no identifiers
are made.

No piece of the vocabulary holds a blank after another character or anything
but a letter after a letter, so no merge reaches over such a place.  A text is
cut there, and the count of a part is kept for its next occurrence, in a cache of
bounded size per Python worker.

Edge cases: null and empty texts have no tokens; very long texts are counted
whole; repeated rows are counted once each; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"
#: Words, and parts of words, whose counts a worker keeps, twice over at most; about 170 bytes each.
CACHE_PARTS = 400_000
#: The same for what is cheaper to make again.
CACHE_KEYS = 150_000
#: A word with the blanks before it, which most texts repeat often.
WORDS = re.compile(" *[^ ]+| +")
#: Of a word: blanks, then other characters, then letters; each may be missing, not all.
#: The vocabulary has one piece of a word character before another kind, U+00B2
#: and a full stop, so that character is not taken for a letter.
PARTS = re.compile(r" *(?:[^\w ]|[\d_²])*[^\W\d_²]+| *(?:[^\w ]|[\d_²])+| +")
#: What no piece may hold for the cuts to be right.
ACROSS = re.compile(r"[^ ] |[^\W\d_²][\W\d_²]")
POSITION_BITS = 32


@functools.cache
def vocabulary(model: str = MODEL) -> dict[str, int]:
    """Rank of each piece that merges can make, lower first, blanks written as blanks.

    Pieces of equal score have equal rank; of those the leftmost goes first.
    """
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    order = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
    ranks = {sp.id_to_piece(i).replace(BLANK, " "): order[sp.get_score(i)] for i in plain}
    if any(ACROSS.search(piece) for piece in ranks):
        raise ValueError(f"{model} has pieces that reach over the places where texts are cut")
    return ranks


def merged_count(part: str, ranks: dict[str, int]) -> int:
    """Tokens of one part."""
    n = len(part)
    rank_of = ranks.get
    pieces: list[str] = list(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for k, pair in enumerate(map(add, pieces, pieces[1:])):
        if (rank := rank_of(pair)) is not None:
            heap.append(rank << POSITION_BITS | k)
    heapify(heap)
    count = n
    while heap:
        key = heappop(heap)
        k = key & ((1 << POSITION_BITS) - 1)
        if not (left := pieces[k]) or (right := after[k]) >= n:
            continue  # the symbol has been merged into another, or is the last
        pair = left + pieces[right]
        if rank_of(pair) != key >> POSITION_BITS:
            continue  # one of the two has grown since
        pieces[k], pieces[right] = pair, ""
        count -= 1
        after[k] = follow = after[right]
        if follow < n:
            before[follow] = k
            if (rank := rank_of(pair + pieces[follow])) is not None:
                heappush(heap, rank << POSITION_BITS | k)
        earlier = before[k]
        if earlier >= 0 and (rank := rank_of(pieces[earlier] + pair)) is not None:
            heappush(heap, rank << POSITION_BITS | earlier)
    for piece in pieces:  # a character that is no piece counts as its bytes
        if piece and piece not in ranks:
            count += len(piece.encode("utf-8", "surrogatepass")) - 1
    return count


class Cache(dict):
    """Values of strings, made when first asked for; the last two generations are kept."""

    def __init__(self, make: Callable[[str], int], most: int = CACHE_KEYS):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> int:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@functools.cache
def word_counts(model: str = MODEL) -> Cache:
    """Token counts of words, from those of their parts."""
    ranks = vocabulary(model)
    parts = Cache(lambda part: merged_count(part, ranks), CACHE_PARTS)
    return Cache(lambda word: sum(map(parts.__getitem__, PARTS.findall(word))), CACHE_PARTS)


def count_tokens(text: str | None, counts: Cache) -> int:
    if not text:
        return 0
    return sum(map(counts.__getitem__, WORDS.findall(" " + text.replace(BLANK, " "))))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(model)
        for batch in batches:
            tokens = pa.array([count_tokens(t.as_py(), counts) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
