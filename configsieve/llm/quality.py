"""Quality scores: ridge regression on random Fourier features, calibrated.

A document is described by counts over its whole text.  Random Fourier features
of these approximate a Gaussian kernel; the normal equations of the ridge fit
are sums over partitions, kept apart by fold.  Scores of each fold under a fit
without it calibrate the final fit by isotonic regression.

Edge cases: null and empty texts are described like any text and get a score;
without labels every score is 0.5, with one kind of label it is that label;
repeated rows are scored once each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm import text_stats as st
from configsieve.llm.labelled import FIT_ROWS, fit_labels, held_out, with_labels
from configsieve.llm.storage import settled

THRESHOLD = 0.3
FEATURES = 256
#: Partitions whose sums come to the driver.
FIT_PARTITIONS = 8
FOLDS = 3
RIDGE = 1.0
WIDTH = 3.0
BINS = 2000
SEED = 11


def described(text: str | None) -> list[float]:
    """What is counted in a text, as shares and logarithms."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = max(len(words), 1), max(st.word_chars(data), 1)
    shares = (
        st.count_of(data, st.SYMBOLS) / n,
        st.count_of(data, st.UPPER) / chars,
        st.count_of(data, st.DIGITS) / chars,
        st.count_of(data, st.PUNCTUATION) / chars,
        data.count(b"!") / n,
        data.count(b"|") / n,
        st.duplicate_lines(data) / (data.count(b"\n") + 1),
        st.repeated_words(words) / n,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(len(w) < 4 for w in words) / n,
        st.count_of(data, bytes(range(0xC0, 0x100))) / chars,
        (data.count(b"\n") + 1) / n,
        data.count(b".") / n,
    )
    # The root spreads small shares, where most texts are.
    return [np.log1p(len(words)), np.log1p(len(data)), min(chars / n, 50.0), np.log1p(max(map(len, words), default=0)), *np.sqrt(np.minimum(shares, 4.0))]


def descriptions(docs: DataFrame) -> DataFrame:
    """doc_id and x, the description, of every document; one pass over the texts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([described(t.as_py()) for t in batch.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(describe, "doc_id long, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Fourier:
    """Random features of standardized descriptions, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, 1 / width, (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        standard = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(standard @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])


def partition_sums(training: DataFrame, columns: list[str], sums) -> list[np.ndarray]:
    """`sums(batch)` added up per partition, one float array for each; there are FIT_PARTITIONS at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["raw"])

    rows = training.select(*columns).coalesce(FIT_PARTITIONS).mapInArrow(add, "raw binary").collect()
    return [np.frombuffer(r["raw"]) for r in rows]


def isotonic(counts: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: the blocks' mean bin numbers and shares, both ascending."""
    blocks: list[list[float]] = []
    for k, (n, p) in enumerate(zip(counts, positives, strict=True)):
        if n:
            blocks.append([n, p, n * k])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Place of a raw score among BINS bins over -0.5 .. 1.5, as a real number."""
    return (np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (BINS - 1)


class Model:
    """Features, weights and calibration."""

    def __init__(self, fourier: Fourier, weights: np.ndarray, bins: np.ndarray, shares: np.ndarray):
        self.fourier, self.weights, self.bins, self.shares = fourier, weights, bins, shares

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(bin_of(self.fourier(x) @ self.weights), self.bins, self.shares)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fitted(rows: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model | Constant:
    """The model learnt from the descriptions of about `bound` labelled documents that are not held out."""
    chosen = settled(fit_labels(labels, "quality", bound), "quality-labels")
    training = settled(with_labels(rows, chosen).repartition(FIT_PARTITIONS, "doc_id"), "quality-rows")
    counts = {r[0]: r[1] for r in training.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Constant(float(next(iter(counts), 0.5)))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    sums = sum(partition_sums(training, ["x"], moments))
    n, width = sums[0], (len(sums) - 1) // 2
    mean = sums[1 : width + 1] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(sums[width + 1 :] / n - mean**2, 0)))
    size = FEATURES + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = fourier(matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        out = np.zeros((FOLDS, size, size + 1))
        for k in range(FOLDS):
            own = z[fold == k]
            out[k, :, :size], out[k, :, size] = own.T @ own, own.T @ y[fold == k]
        return out.ravel()

    sums = sum(partition_sums(training, ["x", "label", "fold"], normal)).reshape(FOLDS, size, size + 1)
    penalty = RIDGE * np.eye(size) / 10
    penalty[-1, -1] = 1e-6

    def solved(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :size] + penalty, total[:, size])

    without = np.array([solved(sums.sum(0) - sums[k]) for k in range(FOLDS)])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = fourier(matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        at = np.rint(bin_of((z * without[fold]).sum(1))).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    sums_by_bin = sum(partition_sums(training, ["x", "label", "fold"], binned))
    bins, shares = isotonic(sums_by_bin[:BINS], sums_by_bin[BINS:])
    return Model(fourier, solved(sums.sum(0)), bins, shares)


def scored(rows: DataFrame, model: Model | Constant) -> DataFrame:
    """doc_id, held_out, score and predicted from descriptions."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of a size that the parameters fix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    out = rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled documents and score all; the texts are read once."""
    rows = settled(descriptions(docs), "descriptions")
    return scored(rows, fitted(rows, labels, bound))
