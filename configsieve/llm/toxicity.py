"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings of four, five and seven
letters, hashed to 32 bits, each as found once, twice, and three times or more: a
beginning that any text may hold once can say much when it comes again.  Terms
that separate the labels on the fitting
sample are kept; on these a factorization machine learns a weight per term and
an inner product per pair of terms, so that two terms can say together what
neither says alone.  Texts of the sample that this machine gets wrong are then
compared with texts of the other label by the pairs of words they hold; words of
the pairs that separate them are kept as well, however little they say alone, and
the machine is fitted once more.  (With parameters for all terms of the sample
the pairs learn single texts by heart.)  Fitting is data-parallel: shards of the
sample run gradient steps from the same parameters, which are then averaged,
round by round.

Edge cases: null and empty texts have no terms and get the score of the bias
alone; a corpus without labels, or with one kind of label, gives the share of
toxic labels (0 without any) as every score; repeated rows are scored once
each; other columns are ignored by `scored` and pass through
`without_toxic`.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm.labelled import FIT_ROWS, fit_labels, held_out, with_labels
from configsieve.llm.storage import settled
from configsieve.llm.token_counts import Cache

THRESHOLD = 0.5
#: Terms with parameters, at most; and pairs of each side whose words get some of their own.
MOST_TERMS = 1 << 16
MOST_PAIRS = 1 << 15
LEAST_DOCS = 3
LEAST_Z = 4.0
#: The same for a pair of words; there are many more pairs to be clear by chance.
LEAST_PAIR_Z = 6.0
#: Texts of the other label for each one that is wrong, about.
COMPARED = 2
#: Pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1 << 20
#: Letters of a word's beginnings, and how often a term is told apart by.
BEGINNINGS = (4, 5, 7)
LEVELS = 3
FACTORS = 8
SHARDS = 8
ROUNDS = 4
EPOCHS = 5
RATE = 0.3
DECAY = 1e-4
#: Counts of terms that a task holds before it passes them on.
HELD_TERMS = 150_000
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»„“”¿¡…"


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and its beginnings; none for a word of marks only."""
    word = word.strip(EDGES)
    if not word:
        return ()
    own = (zlib.crc32(word.encode("utf-8", "surrogatepass")),)
    return own + tuple(zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) for k in BEGINNINGS if len(word) > k)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def levels(found: Iterable[tuple[int, int]]) -> Iterator[int]:
    """The terms of (hash, times found): one for each level up to the times."""
    for term, times in found:
        for level in range(min(times, LEVELS)):
            yield term * LEVELS + level


def text_terms(text: str | None, terms: Cache) -> Iterator[int]:
    found: Counter[int] = Counter()
    for word, times in Counter(words_of(text)).items():
        for term in terms[word]:
            found[term] += times
    return levels(found.items())


def term_counts(training: DataFrame) -> DataFrame:
    """Documents of the sample with each term, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        terms = Cache(word_terms)
        base = 1 << 32

        def rows() -> pa.RecordBatch:
            packed = np.fromiter(sums.values(), np.int64, len(sums))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(sums, np.int64, len(sums))), pa.array(packed // base), pa.array(packed % base)],
                names=["term", "toxic", "other"],
            )

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                one = base if label else 1
                for term in text_terms(text.as_py(), terms):
                    sums[term] = sums.get(term, 0) + one
                if len(sums) > HELD_TERMS:
                    yield rows()
                    sums.clear()
        yield rows()

    counted = training.select("text", "label").mapInArrow(count, "term long, toxic long, other long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def separating_terms(training: DataFrame, toxic: int, other: int) -> list[int]:
    """The terms whose shares among toxic and other texts differ by more than chance, clearest first."""
    share = (F.col("toxic") + F.col("other")) / F.lit(toxic + other)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / toxic + 1 / other))
    z = F.abs((F.col("toxic") / toxic - F.col("other") / other) / spread)
    found = term_counts(training).where(F.col("toxic") + F.col("other") >= LEAST_DOCS).where(share < 1)
    found = found.withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [r[0] for r in found.orderBy(F.desc("z"), "term").limit(MOST_TERMS).select("term").collect()]


def word_hashes(text: str | None) -> np.ndarray:
    """The different words of a text, as hashes in order."""
    words = {w for w in (word.strip(EDGES) for word in words_of(text)) if w}
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64))


def word_pairs(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs of different words, each once, as two hashes in 64 bits; in pieces."""
    for k in range(len(hashes) - 1):
        yield (hashes[k] << np.uint64(32) | hashes[k + 1 :]).view(np.int64)


def frequent_words(found: DataFrame) -> dict[int, np.ndarray]:
    """By label, the hashes of the words in at least LEAST_DOCS of its wrong texts, in order.

    A pair is in no more texts than either of its words, so no pair that counts
    has another word.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                words = word_hashes(text.as_py()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), label.as_py(), np.int32)), pa.array(words)], names=["label", "word"])

    words = found.where("wrong").select("label", "text").mapInArrow(split, "label int, word long")
    counted = words.groupBy("label", "word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    out: dict[int, list[int]] = {0: [], 1: []}
    for label, word in counted.select("label", "word").collect():
        out[label].append(word)
    return {label: np.array(sorted(words), np.uint64) for label, words in out.items()}


def separating_pairs(found: DataFrame, wrong: dict[int, int], right: dict[int, int]) -> list[int]:
    """The words, as terms, of pairs that separate wrong texts from others of the other label.

    `found` has label, wrong and text; `wrong` and `right` count its rows by label.
    """

    frequent = frequent_words(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (label, bad), parts in held.items():
                pair, n = np.unique(np.concatenate(parts), return_counts=True)
                # Wrong texts of a label and the texts of the other label that they are compared with.
                side = pa.array(np.full(len(pair), label if bad else 1 - label, np.int32))
                columns = [side, pa.array(pair), pa.array(n * bad), pa.array(n * (not bad))]
                yield pa.RecordBatch.from_arrays(columns, names=["side", "pair", "bad", "good"])
            held.clear()

        size = 0
        for batch in batches:
            for label, bad, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                label, bad = label.as_py(), bad.as_py()
                side = frequent[label if bad else 1 - label]
                for piece in word_pairs(np.intersect1d(word_hashes(text.as_py()), side, assume_unique=True)):
                    held.setdefault((label, bad), []).append(piece)
                    size += len(piece)
                    if size > HELD_PAIRS:
                        yield from rows()
                        size = 0
        yield from rows()

    counted = found.select("label", "wrong", "text").mapInArrow(count, "side int, pair long, bad long, good long")
    counted = counted.groupBy("side", "pair").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words: dict[int, None] = {}
    for side in (1, 0):
        bad, good = wrong.get(side, 0), right.get(1 - side, 0)
        if not bad or not good:
            continue
        share = (F.col("bad") + F.col("good")) / F.lit(bad + good)
        z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * F.lit(1 / bad + 1 / good))
        own = counted.where((F.col("side") == side) & (F.col("bad") >= LEAST_DOCS)).where(share < 1)
        own = own.withColumn("z", z).where(F.col("z") >= LEAST_PAIR_Z)
        for (pair,) in own.orderBy(F.desc("z"), "pair").limit(MOST_PAIRS).select("pair").collect():
            words.update(dict.fromkeys(((pair >> 32 & 0xFFFFFFFF) * LEVELS, (pair & 0xFFFFFFFF) * LEVELS)))
    return list(words)


class Machine:
    """Bias, weights and factors by term number."""

    def __init__(self, terms: list[int], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    @classmethod
    def fresh(cls, terms: list[int], bias: float) -> Machine:
        factors = np.random.default_rng(7).normal(0, 0.05, (len(terms), FACTORS))
        return cls(terms, bias, np.zeros(len(terms)), factors)

    @functools.cached_property
    def numbers(self) -> dict[int, int]:
        return {term: k for k, term in enumerate(self.terms)}

    @functools.cached_property
    def words(self) -> Cache:
        """The hashes of a word that have parameters at some level."""
        known = {term // LEVELS for term in self.terms}
        return Cache(lambda word: tuple(t for t in word_terms(word) if t in known))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "numbers")}

    def active(self, text: str | None) -> np.ndarray:
        found: Counter[int] = Counter()
        for hashes in filter(None, map(self.words.__getitem__, words_of(text))):
            found.update(hashes)
        return np.array(sorted(self.numbers[t] for t in levels(found.items()) if t in self.numbers), dtype=np.int64)

    def margin(self, active: np.ndarray) -> float:
        own = self.factors[active]
        pairs = 0.5 * float((own.sum(0) ** 2 - (own**2).sum(0)).sum())
        return self.bias + float(self.weights[active].sum()) + pairs

    def score(self, active: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(active)))))


def stepped(machine: Machine, rows: list[tuple[int, np.ndarray]], seed: int) -> Machine:
    """A copy of the machine after some epochs of adaptive gradient steps over the rows."""
    bias, weights, factors = machine.bias, machine.weights.copy(), machine.factors.copy()
    own = Machine(machine.terms, bias, weights, factors)
    seen_bias, seen_w, seen_f = 1.0, np.ones(len(weights)), np.ones(factors.shape)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, active = rows[k]
            slope = own.score(active) - label
            seen_bias += slope**2
            own.bias -= RATE * slope / math.sqrt(seen_bias)
            if not len(active):
                continue
            grad = slope + DECAY * weights[active]
            seen_w[active] += grad**2
            weights[active] -= RATE * grad / np.sqrt(seen_w[active])
            mine = factors[active]
            grad = slope * (mine.sum(0) - mine) + DECAY * mine
            seen_f[active] += grad**2
            factors[active] -= RATE / 3 * grad / np.sqrt(seen_f[active])
    return own


def shard_step(machine: Machine, seed: int):
    """The steps of one shard, as a function from its rows to one row of parameters."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["active"].map(len)).sort_values(["doc_id", "label", "size"], kind="stable")
        rows = [(int(y), np.asarray(a, dtype=np.int64)) for y, a in zip(pdf["label"], pdf["active"], strict=True)]
        new = stepped(machine, rows, seed)
        raw = np.concatenate([[new.bias], new.weights, new.factors.ravel()]).astype(np.float32).tobytes()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(rows)], "raw": [raw]})

    return step


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """The machine learnt from about `rows` labelled documents that are not held out."""
    chosen = settled(fit_labels(labels, "toxic", rows), "toxic-labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = settled(with_labels(text, chosen), "toxic-texts")
    counts = {r[0]: r[1] for r in training.groupBy("label").count().collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    share = min(max(toxic / max(toxic + other, 1), 1e-9), 1 - 1e-9)
    bias = math.log(share / (1 - share))
    if not toxic or not other:
        return Machine.fresh([], bias)
    terms = separating_terms(training, toxic, other)
    machine = averaged(training, terms, bias)
    together = [t for t in wrong_words(training, machine) if t not in set(terms)]
    # Words of pairs come on top: the terms that separate by themselves never take their place.
    return averaged(training, terms + together, bias) if together else machine


def wrong_words(training: DataFrame, machine: Machine) -> list[int]:
    """`separating_pairs` of the texts that the machine gets wrong and a sample of the others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = [machine.score(machine.active(t.as_py())) >= THRESHOLD for t in batch.column(2)]
            wrong = pa.array([h != bool(y) for h, y in zip(high, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wrong, batch.column(2)], names=["doc_id", "label", "wrong", "text"])

    found = training.select("doc_id", "label", "text").mapInArrow(find, "doc_id long, label int, wrong boolean, text string")
    found = settled(found, "toxic-wrong")
    sizes = {(r[0], r[1]): r[2] for r in found.groupBy("label", "wrong").count().collect()}
    wrong = {y: sizes.get((y, True), 0) for y in (0, 1)}
    scale, draw = 1 << 20, F.pmod(F.xxhash64("doc_id", F.lit("compared")), F.lit(1 << 20))
    share = {y: min(1.0, COMPARED * wrong[1 - y] / max(sizes.get((y, False), 0), 1)) for y in (0, 1)}
    picked = F.lit(False)
    for y in (0, 1):
        picked = picked | ((F.col("label") == y) & (draw < int(share[y] * scale)))
    compared = settled(found.where(F.col("wrong") | picked), "toxic-compared")
    right = {r[0]: r[1] for r in compared.where("NOT wrong").groupBy("label").count().collect()}
    return separating_pairs(compared, wrong, right)


def averaged(training: DataFrame, terms: list[int], bias: float) -> Machine:
    """The machine over these terms, by rounds of steps on shards."""
    machine = Machine.fresh(terms, bias)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            active = pa.array([machine.active(t.as_py()) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), active], names=["doc_id", "label", "active"])

    found = training.select("doc_id", "label", "text").mapInArrow(find, "doc_id long, label int, active array<long>")
    found = settled(found.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS))), "toxic-terms")

    for turn in range(ROUNDS):
        step = shard_step(machine, turn)
        parts = sorted(found.groupBy("shard").applyInPandas(step, "shard long, n long, raw binary").collect())
        total = sum(r["n"] for r in parts)
        mean = sum(np.frombuffer(r["raw"], np.float32).astype(float) * (r["n"] / total) for r in parts)
        n = len(machine.terms)
        machine = Machine(machine.terms, float(mean[0]), mean[1 : n + 1].copy(), mean[n + 1 :].reshape(n, FACTORS).copy())
    return machine


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most MOST_TERMS terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = pa.array([own.score(own.active(t.as_py())) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    # Only texts go to Python, and a boolean comes back.
    @F.arrow_udf("boolean")
    def harmless(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([own.score(own.active(t.as_py())) < threshold for t in texts], pa.bool_())

    return docs.where(harmless(F.col("text").cast("string")))
