"""Quality rules as a short-circuit cascade.

Each rule says whether a text is rejected.  On a sample the cost of a rule
(seconds per text) and its rejections are measured; rules then run in the order
of rejections per cost, and a text leaves the cascade at the first rule that
rejects it.  A text is kept if no rule rejects it, so the order decides the
time that is spent, never the result.

Edge cases: a null text has no words and is rejected as too short; an empty
table gives an empty result; repeated rows are judged once each; other columns
pass through `kept_documents` and are ignored by the query.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm import text_stats as st

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Texts that cost and selectivity are estimated on, about.
SAMPLE_ROWS = 2_000


class Text:
    """A text and what rules have counted in it so far."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")
        self._words: list[bytes] | None = None
        self._chars: int | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.data.split()
        return self._words

    @property
    def chars(self) -> int:
        if self._chars is None:
            self._chars = st.word_chars(self.data)
        return self._chars


def too_few_words(t: Text) -> bool:
    return len(t.words) < LEAST_WORDS


def repeated_text(t: Text) -> bool:
    return 100 * st.repeated_words(t.words) > MOST_REPEATED_PERCENT * len(t.words)


def many_symbols(t: Text) -> bool:
    """More than one symbol in ten words."""
    return 10 * st.count_of(t.data, st.SYMBOLS) > len(t.words)


def odd_word_length(t: Text) -> bool:
    """Fewer than 2 or more than 15 characters in a word, on average."""
    n = len(t.words)
    return not 2 * n <= t.chars <= 15 * n


def repeated_lines(t: Text) -> bool:
    """More than half of the lines equal an earlier one."""
    repeats = st.duplicate_lines(t.data)
    return repeats > 0 and 2 * repeats > t.data.count(b"\n") + 1


def mostly_capitals(t: Text) -> bool:
    """More than three ASCII capitals among ten characters of words."""
    return 10 * st.count_of(t.data, st.UPPER) > 3 * t.chars


def many_digits(t: Text) -> bool:
    """More than three digits among ten characters of words."""
    return 10 * st.count_of(t.data, st.DIGITS) > 3 * t.chars


def shouting(t: Text) -> bool:
    """More than one exclamation mark in five words."""
    return 5 * t.data.count(b"!") > len(t.words)


Rule = Callable[[Text], bool]

BASE: dict[str, Rule] = {"too_few_words": too_few_words, "repeated_text": repeated_text}
FURTHER: dict[str, Rule] = {
    f.__name__: f
    for f in (many_symbols, odd_word_length, repeated_lines, mostly_capitals, many_digits, shouting)
}
RULES = BASE | FURTHER


def rejected_by(t: Text, rules: list[tuple[str, Rule]]) -> str | None:
    """The first rule that rejects; later ones are not run."""
    for name, rule in rules:
        if rule(t):
            return name
    return None


def measured(docs: DataFrame, rules: dict[str, Rule] = RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[int, int, float]]:
    """Texts, rejections and seconds of each rule, on about `rows` texts from all over the table.

    Every rule runs on a text of its own, so that no rule pays for counts
    that another one has left behind.
    """
    share = min(1.0, rows / max(docs.count(), 1))
    scale = 1 << 40
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(scale)) < int(share * scale))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: [0, 0, 0.0] for name in rules}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for name, rule in rules.items():
                    t = Text(text)
                    start = time.process_time()
                    rejects = rule(t)
                    seconds = time.process_time() - start
                    own = sums[name]
                    own[0], own[1], own[2] = own[0] + 1, own[1] + rejects, own[2] + seconds
        yield pa.RecordBatch.from_pylist([{"rule": k, "n": v[0], "rejects": v[1], "seconds": v[2]} for k, v in sums.items()])

    found = sample.select(F.col("text").cast("string")).mapInArrow(measure, "rule string, n long, rejects long, seconds double")
    sums = found.groupBy("rule").agg(F.sum("n"), F.sum("rejects"), F.sum("seconds")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in sums}


def ordered(rules: dict[str, Rule], seen: dict[str, tuple[int, int, float]]) -> list[tuple[str, Rule]]:
    """By rejections per second, most first; a rule that rejects nothing comes by its cost."""

    def rank(name: str) -> tuple[float, float]:
        n, rejects, seconds = seen.get(name, (0, 0, 0.0))
        cost = max(seconds, 1e-9) / max(n, 1)
        return -((rejects / max(n, 1)) / cost), cost

    return [(name, rules[name]) for name in sorted(rules, key=rank)]


def kept_documents(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns."""
    order = ordered(rules, measured(docs, rules))

    # Only texts go to Python, and a boolean comes back.
    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return pa.array([rejected_by(Text(t.as_py()), order) is None for t in texts], pa.bool_())

    return docs.where(passes(F.col("text").cast("string")))


COUNTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


def judged(docs: DataFrame, further: dict[str, Rule] = FURTHER) -> DataFrame:
    """The base counts of every document, and the verdict of the cascade on those that pass the base."""
    order = ordered(further, measured(docs, further))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = Text(text.as_py())
                n, repeats = len(t.words), st.repeated_words(t.words)
                failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * n
                kept = not failed and rejected_by(t, order) is None
                rows.append((doc_id, n, t.chars, st.count_of(t.data, st.SYMBOLS), st.duplicate_lines(t.data), repeats, failed, kept))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            names = [field.split()[0] for field in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, COUNTS)
