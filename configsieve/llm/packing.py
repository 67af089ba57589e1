"""Packing token sequences: minimum bin slack over the histogram of lengths.

Documents become pieces of at most `size` tokens.  Per sequence ("bin"), a
bitset subset-sum over the lengths still available finds the fullest feasible
combination, which is then removed.  Pieces of equal length are
interchangeable, so the search runs on the histogram of lengths (at most `size`
rows, whatever the corpus) and a combination is taken as often as the counts
allow before the next one is searched.  Each piece finds its place by its rank
among the pieces of its length.

Edge cases: a null text counts as empty; an empty text is one piece that holds
only the end token; repeated rows are packed once each; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from configsieve.llm.storage import settled

SIZE = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Rows of one length that one task ranks.
RANK_ROWS = 2_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread int"
SPECIAL = "<|endoftext|>"
#: White space other than blank and line feed, as Unicode has it and Python adds.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
SPACE_RUNS = ("  ", "\n\n", " \n", "\n ")


@functools.cache
def _encoders(name: str):
    """Encoders of one vocabulary: for any text, and for texts without runs of white space.

    The general pattern needs lookahead, which the regular-expression engine
    runs a third slower.  Where no two white-space characters meet, dropping
    it changes nothing.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    general = public_tokenizers.PATTERN
    plain = general.removesuffix(r"|\s+(?!\S)|\s+") + r"|\s"

    def encoder(pattern: str):
        return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return encoder(general), encoder(plain), len(ranks)


def encode(text: str, name: str = TOKENIZER) -> list[int]:
    """The ids that the `tokenizers` library gives for `<name>.json`, no special tokens added.

    The special string itself, where a text holds it, is one id, as there.
    """
    general, plain, special_id = _encoders(name)
    if SPECIAL in text:
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            ids += [special_id] * (k > 0) + encode(part, name)
        return ids
    runs = any(x in text for x in SPACE_RUNS) or any(x in text for x in OTHER_SPACE)
    return (general if runs else plain)(text)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a shorter first one if n is no multiple."""
    first = n % size or min(n, size)
    return [(0, first), *((start, size) for start in range(first, n, size))]


def document_pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece, in one pass over the texts; nothing is shuffled.

    `spread` numbers the rows of a task and only serves to deal out equal rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = 0
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", tokenizer)
                ids.append(END_ID)
                raw = array("I", ids).tobytes()
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, k, start, length, crc, spread), strict=True):
                        column.append(value)
                    spread = (spread + 1) % (1 << 31)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "spread")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def fullest(lengths: list[int], counts: list[int], size: int) -> list[tuple[int, int]]:
    """The fullest combination of at most `size` tokens: (length, times), longest first.

    `lengths` ascend.  Bit s of a mask says that the lengths so far can make
    the sum s.  Among equally full combinations the one with more of the
    longest lengths is taken: short pieces fill gaps best and are kept.
    """
    limit = (1 << (size + 1)) - 1
    masks = [1]
    for length, count in zip(lengths, counts, strict=True):
        mask, left, step = masks[-1], min(count, size // length), 1
        while left:  # 1, 2, 4, ... copies at a time
            take = min(step, left)
            mask |= (mask << (take * length)) & limit
            left, step = left - take, 2 * step
        masks.append(mask)
    rest = masks[-1].bit_length() - 1
    chosen = []
    for k in range(len(lengths) - 1, -1, -1):
        times = min(counts[k], rest // lengths[k])
        while times and not masks[k] >> (rest - times * lengths[k]) & 1:
            times -= 1
        if times:
            chosen.append((lengths[k], times))
            rest -= times * lengths[k]
        elif not rest:
            break
    return chosen


def combinations(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """All sequences, as (how many alike, [(length, times in each)])."""
    left, out = dict(sorted(histogram.items())), []
    while left:
        chosen = fullest(list(left), list(left.values()), size)
        alike = min(left[length] // times for length, times in chosen)
        out.append((alike, chosen))
        for length, times in chosen:
            left[length] -= alike * times
            if not left[length]:
                del left[length]
    return out


def places(plan: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[str, np.ndarray]:
    """Where the ranks of each length go, sorted by length and first rank.

    A row covers the ranks of a length from `key % span` on; of these, `times`
    go to each sequence, from `sequence` and `offset` on.  There are at most
    a few rows per length and combination, whatever the corpus.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for alike, chosen in plan:
        offset = 0
        for length, times in chosen:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + alike * times
            offset += times * length
        sequence += alike
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "sequence", "offset"), columns, strict=True))


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with their rank among those of the same length, from 0.

    A length may hold a third of all pieces, so the pieces of a length are
    dealt to buckets of about RANK_ROWS; a rank is the sizes of the buckets
    before plus the rank within the bucket.
    """
    spark = pieces.sparkSession
    # One row per length, at most as many as a sequence has tokens: joined without dealing pieces by length.
    buckets = F.broadcast(spark.createDataFrame(
        [(length, -(-count // RANK_ROWS)) for length, count in histogram.items()], "length long, n_buckets long"
    ))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "spread"), "n_buckets")
    dealt = pieces.join(buckets, "length").withColumn("bucket", bucket)
    within = Window.partitionBy("length", "bucket")
    dealt = dealt.withColumn("place", F.row_number().over(within.orderBy("doc_id", "piece", "ids_crc32", "spread")) - 1)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.join(buckets, "length").withColumn("bucket", bucket).groupBy("length", "bucket").agg(F.count("*").alias("n"))
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Dealt by both columns: a join could else reuse the window's dealing by length alone.
    return dealt.join(bases.repartition("length", "bucket"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: gapless sequences of at most `size` tokens.

    `pieces` is read twice, so it should be a settled table.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    table = spark.sparkContext.broadcast(places(combinations(histogram, size), size))
    span = max(histogram.values(), default=0) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        keys = slots["length"] * span + slots["first"]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            nth = rank - slots["first"][k]
            times = slots["times"][k]
            sequence = slots["sequence"][k] + nth // times
            offset = slots["offset"][k] + nth % times * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked(pieces, histogram).select(*columns).mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize, cut and pack all documents; one row per piece (see `PACKED`)."""
    return packed(settled(document_pieces(docs, size, tokenizer), "pieces"), size)
