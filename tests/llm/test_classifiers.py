"""Held-out accuracy of the two classifiers, and their edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from configsieve.llm import labelled, quality, toxicity

SF_DIR = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels")]


def outcome(rows, labels, column):
    want = {r.doc_id: r[column] for r in labels.collect()}
    return Counter((want[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in want)


def test_fit_labels_are_not_held_out(spark, tables):
    ids = [r.doc_id for r in labelled.fit_labels(tables[1], "toxic", 500).collect()]
    assert 300 < len(ids) < 700
    assert not any(map(held_out, ids))


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    rows = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = outcome(rows, labels, "toxic")
    # One label in twenty is given at random: such a text has nothing toxic in it.
    assert seen[1, 1] >= 0.85 * (seen[1, 0] + seen[1, 1])
    assert seen[0, 1] <= 0.01 * (seen[0, 0] + seen[0, 1])


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    rows = quality.quality_scores(docs, labels).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    seen = outcome(rows, labels, "quality")
    assert seen[0, 0] >= 0.85 * (seen[0, 0] + seen[0, 1])
    assert seen[1, 1] >= 0.98 * (seen[1, 0] + seen[1, 1])


def test_pairs_say_what_terms_alone_do_not(spark):
    """An insult or a group alone is no toxicity, both are; no sum of weights can say that of all four."""
    rows = []
    for k in range(800):
        insult, group = k % 2, k // 2 % 2
        text = ("insultword " if insult else "mildword ") + ("groupword " if group else "thingword ") + f"filler{k % 17}"
        rows.append((k, text, int(insult == group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.Machine.fresh(sorted({t * toxicity.LEVELS for r in rows for w in r[1].split() for t in toxicity.word_terms(w)}), 0.0)
    active = [(y, machine.active(text)) for _, text, y in rows]
    for turn in range(6):
        machine = toxicity.stepped(machine, active, turn)
    right = sum((machine.score(a) >= 0.5) == bool(y) for y, a in active)
    assert right >= 0.95 * len(rows)
    assert toxicity.scored(docs, machine).count() == len(rows)


def test_fitting_finds_terms_that_matter_only_in_pairs(spark):
    """No term of such texts has a share that differs by label; the fit has to find them by their pairs."""
    rng, rows = np.random.default_rng(5), []
    for k in range(6000):
        insult, group = k % 2, k // 2 % 2
        filler = " ".join(f"filler{x}" for x in rng.integers(0, 200, 20))
        text = ("insultword " if insult else "mildword ") + filler + (" groupword" if group else " thingword")
        rows.append((k, text, int(insult == group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    want = {k: y for k, _, y in rows}
    found = [r for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect() if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in found) >= 0.95 * len(found)


def test_isotonic():
    bins, shares = quality.isotonic(np.array([2, 0, 2, 4, 1]), np.array([1, 0, 0, 3, 1]))
    assert bins.tolist() == [1.0, 3.0, 4.0]
    assert shares.tolist() == [0.25, 0.75, 1.0]


def test_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(30, 4))
    fourier = quality.Fourier(np.zeros(4), np.ones(4), features=20_000, width=2.0)
    z = fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


@pytest.mark.parametrize("values", [[], [(1, 1, 1), (4, 1, 1)], [(1, 0, 1), (2, 1, 0), (4, 1, 1), (6, 0, 0), (6, 1, 1), (None, 1, 1), (8, None, None)]])
def test_odd_documents(spark, odd_documents, no_documents, values):
    labels = spark.createDataFrame(values, "doc_id long, quality int, toxic int")
    ids = Counter(d.doc_id for d in odd_documents.collect())
    machine = toxicity.fitted(odd_documents, labels)
    for rows in (toxicity.scored(odd_documents, machine), quality.quality_scores(odd_documents, labels)):
        found = rows.collect()
        assert Counter(r.doc_id for r in found) == ids
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert toxicity.without_toxic(odd_documents, machine).columns == odd_documents.columns
    assert toxicity.scored(no_documents, machine).count() == quality.quality_scores(no_documents, labels).count() == 0


def test_only_pairs_of_frequent_words_are_made(spark):
    """A text of 20,000 words of its own makes no pairs beyond those that can count."""
    own = [f"w{n}" for n in range(20_000)]
    rows = [(k, 1, True, f"insult group other{k}") for k in range(6)] + [(6, 1, True, " ".join(own) + " insult group")]
    rows += [(10 + k, 0, False, ("insult " if k % 2 else "group ") + " ".join(own)) for k in range(8)]
    found = spark.createDataFrame(rows, "doc_id long, label int, wrong boolean, text string")
    frequent = toxicity.frequent_words(found)
    assert {k: len(v) for k, v in frequent.items()} == {0: 0, 1: 2}
    words = toxicity.separating_pairs(found, {1: 7, 0: 0}, {0: 8, 1: 0})
    assert sorted(w // toxicity.LEVELS for w in words) == sorted(zlib.crc32(w) for w in (b"insult", b"group")) or words == []


def test_terms_never_take_the_place_of_pairs(spark, monkeypatch):
    """The screen of single terms fills its table; the interaction is learnt all the same."""
    monkeypatch.setattr(toxicity, "MOST_TERMS", 4)
    calls = []
    monkeypatch.setattr(toxicity, "averaged", lambda training, terms, bias: calls.append(list(terms)) or toxicity.Machine.fresh(terms, bias))
    monkeypatch.setattr(toxicity, "separating_terms", lambda *_: [1, 2, 3, 4])
    monkeypatch.setattr(toxicity, "wrong_words", lambda *_: [4, 5, 6])
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    toxicity.fitted(docs, labels)
    assert calls == [[1, 2, 3, 4], [1, 2, 3, 4, 5, 6]]


def test_quality_fit_by_hand(spark):
    """Sums over partitions against one least-squares fit of all rows; calibration against its minimax form."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.settled(quality.descriptions(docs), "test-descriptions")
    model = quality.fitted(rows, labels)
    picked = labelled.with_labels(rows, labelled.fit_labels(labels, "quality")).collect()
    assert picked and not any(held_out(r.doc_id) for r in picked)
    x, y = np.array([r.x for r in picked], float), np.array([r.label for r in picked], float)
    fold = np.array([r.fold for r in picked])
    assert np.allclose(model.fourier.mean, x.mean(0)) and np.allclose(model.fourier.spread, np.where(x.std(0) > 1e-9, x.std(0), 1), atol=1e-5)
    z = model.fourier(x)
    penalty = np.sqrt(np.append(np.full(z.shape[1] - 1, quality.RIDGE / 10), 1e-6))

    def ridge(own):
        """The least squares of the rows and the penalty's rows, without normal equations."""
        return np.linalg.lstsq(np.vstack([z[own], np.diag(penalty)]), np.concatenate([y[own], np.zeros(len(penalty))]), rcond=None)[0]

    weights = ridge(np.ones(len(y), bool))
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-6)
    out_of_fold = np.empty(len(y))
    for k in range(quality.FOLDS):
        out_of_fold[fold == k] = z[fold == k] @ ridge(fold != k)
    at = np.rint(quality.bin_of(out_of_fold)).astype(int)
    used = np.unique(at)
    n, good = (np.array([f(at == b) for b in used], float) for f in (np.sum, lambda own: y[own].sum()))
    n, good = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], good.cumsum()])
    # The isotonic value at k: the largest, over starts before k, of the least mean up to an end after k.
    least = [[min((good[j] - good[i]) / (n[j] - n[i]) for j in range(k + 1, len(n))) for i in range(k + 1)] for k in range(len(used))]
    isotonic = np.array([max(own) for own in least])
    blocks = [used[isotonic == v] for v in np.unique(isotonic)]
    centres = [np.average(b, weights=[(at == q).sum() for q in b]) for b in blocks]
    assert np.allclose(model.shares, np.unique(isotonic), atol=1e-9) and np.allclose(model.bins, centres, atol=1e-6)
    scores = {r.doc_id: r.score for r in quality.scored(rows, model).collect()}
    want = np.interp(quality.bin_of(z @ weights), centres, np.unique(isotonic))
    assert np.allclose([scores[r.doc_id] for r in picked], want, atol=1e-3)


def naive_margin(machine, active):
    """Every pair of active terms by itself."""
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(active) for j in active[:a])
    return machine.bias + sum(machine.weights[i] for i in active) + pairs


def test_margins_by_hand():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(list(range(40)), -0.7, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    for n in (0, 1, 2, 7, 40):
        active = rng.choice(40, n, replace=False)
        margin = naive_margin(machine, active)
        assert machine.margin(active) == pytest.approx(margin)
        assert machine.score(active) == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


@pytest.mark.parametrize("label", [0, 1])
def test_a_step_goes_down_the_loss(monkeypatch, label):
    """One step against the slopes of the loss, by differences."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = np.random.default_rng(label)
    machine = toxicity.Machine(list(range(6)), 0.2, rng.normal(0, 0.5, 6), rng.normal(0, 0.5, (6, toxicity.FACTORS)))
    active = np.array([0, 2, 5])
    start = np.concatenate([[machine.bias], machine.weights, machine.factors.ravel()])

    def loss(flat):
        own = toxicity.Machine(machine.terms, flat[0], flat[1:7], flat[7:].reshape(6, -1))
        used = np.concatenate([own.weights[active], own.factors[active].ravel()])
        return np.log1p(np.exp((1 - 2 * label) * naive_margin(own, active))) + toxicity.DECAY / 2 * (used**2).sum()

    slopes = np.array([(loss(start + h) - loss(start - h)) / 2e-6 for h in np.eye(len(start)) * 1e-6])
    rates = np.where(np.arange(len(start)) < 7, toxicity.RATE, toxicity.RATE / 3)
    new = toxicity.stepped(machine, [(label, active)], 0)
    got = np.concatenate([[new.bias], new.weights, new.factors.ravel()])
    assert np.allclose(got, start - rates * slopes / np.sqrt(1 + slopes**2), atol=1e-6)
    rest = [1, 3, 4]
    assert (new.weights[rest] == machine.weights[rest]).all() and (new.factors[rest] == machine.factors[rest]).all()


def test_scores_of_texts_by_hand(spark, odd_documents):
    """The terms of a text, told apart by how often it has them, and its margin, all by themselves."""
    rng = np.random.default_rng(8)
    vocabulary = sorted({t for word in ("w1", "one", "go", "same", "line") for t in toxicity.word_terms(word)})
    terms = [t * toxicity.LEVELS + level for t in vocabulary for level in range(toxicity.LEVELS)]
    machine = toxicity.Machine(terms, 0.1, rng.normal(size=len(terms)), rng.normal(0, 0.3, (len(terms), toxicity.FACTORS)))
    number = {t: k for k, t in enumerate(terms)}
    want = Counter()
    for d in odd_documents.collect():
        times = Counter(t for word in (d.text or "").lower().split() for t in toxicity.word_terms(word))
        active = [number[t * toxicity.LEVELS + level] for t in vocabulary for level in range(min(times[t], toxicity.LEVELS))]
        score = 1 / (1 + np.exp(-np.clip(naive_margin(machine, active), -30, 30)))
        want[d.doc_id, round(float(score), 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.scored(odd_documents, machine).collect()) == want
