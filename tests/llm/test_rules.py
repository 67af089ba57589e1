"""The cascade against its rules one by one; counts against plain Python."""

import itertools
from collections import Counter

from configsieve.llm import rules
from configsieve.llm import text_stats as st
from tests.llm.conftest import ODD_TEXTS, words

BAD = [words(1, 80) + " ***" * 20, ("W" * 9 + " ") * 3 + words(2, 60).upper(), " ".join(f"{k}!!" for k in range(70)), "1 " * 10 + words(3, 90)]


def repeated(ws):
    times = Counter(zip(ws, ws[1:], ws[2:]))
    return len({k + d for k in range(len(ws) - 2) if times[tuple(ws[k : k + 3])] > 1 for d in range(3)})


def test_counts():
    for text in [*ODD_TEXTS, *BAD, "a b c a b c d", "x\nx\n \nx y\nx"]:
        data = (text or "").encode()
        ws = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        t = rules.Text(text)
        assert [w.decode() for w in t.words] == ws
        assert t.chars == sum(map(len, ws))
        assert st.repeated_words(t.words) == repeated(ws)
        assert st.count_of(data, st.SYMBOLS) == sum(c in "#*$%&|<>" for c in text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert st.duplicate_lines(data) == len(lines) - len(set(lines))


def test_order_does_not_change_the_verdict():
    names = list(rules.RULES.items())
    for text in [*ODD_TEXTS, *BAD]:
        verdicts = {rules.rejected_by(rules.Text(text), [names[k] for k in order]) is None
                    for order in itertools.islice(itertools.permutations(range(len(names))), 0, 40_000, 997)}
        assert verdicts == {not any(rule(rules.Text(text)) for rule in rules.RULES.values())}


def test_order_is_by_rejections_per_cost():
    seen = {"a": (10, 5, 1.0), "b": (10, 5, 0.1), "c": (10, 0, 0.01), "d": (10, 1, 0.001)}
    assert [name for name, _ in rules.ordered(dict.fromkeys(seen, None), seen)] == ["d", "b", "a", "c"]


def test_a_rejecting_rule_ends_the_cascade():
    ran = []

    def rule(name, answer):
        return name, lambda t: ran.append(name) or answer

    assert rules.rejected_by(rules.Text("a"), [rule("x", False), rule("y", True), rule("z", True)]) == "y"
    assert ran == ["x", "y"]


def test_measured_counts_every_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = rules.measured(docs)
    texts = [r.text for r in docs.collect()]
    assert {k: (n, r) for k, (n, r, _) in seen.items()} == {
        k: (len(texts), sum(rule(rules.Text(t)) for t in texts)) for k, rule in rules.RULES.items()
    }


def test_documents(odd_documents, no_documents):
    kept = rules.kept_documents(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(d.doc_id, d.text) for d in odd_documents.collect()]
    good = {t: not any(rule(rules.Text(t)) for rule in rules.RULES.values()) for _, t in texts}
    assert Counter((d.doc_id, d.text) for d in kept.collect()) == Counter(x for x in texts if good[x[1]])
    judged = rules.judged(odd_documents).collect()
    assert Counter((r.doc_id, r.kept) for r in judged) == Counter((i, good[t]) for i, t in texts)
    assert rules.kept_documents(no_documents).count() == rules.judged(no_documents).count() == 0
