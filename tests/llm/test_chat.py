"""Repairs against all ways to repair, and the rendered text read back."""

import itertools
import random
import re
from collections import defaultdict

import pytest

from configsieve.llm import chat

SF_DIR = "/root/testdata/sf0.001"


def cost_of(known, roles):
    """Cost of giving the turns these roles, or None if that can't be made legal."""
    total, state = 0, chat.START
    for have, to in zip(known, roles):
        if (state, to) not in chat.WAYS:
            return None
        total += chat.WAYS[state, to][0] + chat.relabelling(have, to)
        state = to
    return total + chat.STOP[state]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_no_way_is_cheaper(length):
    for known in itertools.product(range(4), repeat=length):
        way = chat.states([chat.stretch(list(known))])
        roles = chat.assigned(list(known), way[0], way[1])
        # What somebody else said is never called an answer, or a rule.
        assert all(have in (0, to) for have, to in zip(known, roles) if to != chat.USER)
        best = cost_of(known, roles)
        costs = [c for roles in itertools.product((1, 2, 3), repeat=length) if (c := cost_of(known, roles)) is not None]
        assert best == min(costs)


def test_chunks_cost_no_more_than_the_whole():
    rng = random.Random(3)
    for _ in range(100):
        known = [rng.randrange(4) for _ in range(40)]
        way = chat.states([chat.stretch(known[k : k + 7]) for k in range(0, 40, 7)])
        roles = [r for k, c in enumerate(range(0, 40, 7)) for r in chat.assigned(known[c : c + 7], way[k], way[k + 1])]
        whole = chat.states([chat.stretch(known)])
        assert cost_of(known, roles) == cost_of(known, chat.assigned(known, *whole))


def legal(roles):
    roles = roles[1:] if roles[0] == "system" else roles
    return bool(roles) and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def read_back(rows):
    """conv -> [(role, text)] from the rendered pieces."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.conv_id].append((r.turn, r.place, r.piece))
    out = {}
    for conv, own in pieces.items():
        text = "".join(p for _, _, p in sorted(own, key=lambda x: x[:2]))
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns) == text
        out[conv] = turns
    return out


def test_legal_conversations_are_left_alone(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    back, want = read_back(chat.formatted(turns).collect()), defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append((r.role, r.text))
    for conv, own in want.items():
        if legal([r for r, _ in own]):
            assert back[conv] == own
        assert legal([r for r, _ in back[conv]])


@pytest.mark.parametrize("chunk", [512, 3])
def test_odd_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "bot", None]), rng.choice(["x y", "", None, "zz"])) for c in range(60) for t in range(c % 13 + 1)]
    rows += [(7, 2, "user", "again"), (7, 2, "user", "again"), (None, None, None, None), (90, 0, "system", "only")]
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int, conv int")
    out = chat.formatted(frame).collect()
    assert len(out) == len(rows)
    back, words = read_back(out), defaultdict(list)
    for c, _, _, text in rows:
        words[-1 if c is None else c] += (text or "").split()
    for conv, turns in back.items():
        assert legal([r for r, _ in turns])
        assert sorted(" ".join(t for _, t in turns).split()) == sorted(words[conv])
    assert back[90] == [("user", "only")]  # a new role is cheaper than an empty turn
    assert chat.formatted(frame.where("false")).count() == 0


@pytest.mark.parametrize(
    ("given", "want", "inserted"),
    [
        (["assistant", "user"], ["user", "assistant", "user"], 1),
        (["system", "assistant"], ["system", "user", "assistant"], 1),
        (["assistant", "assistant", "user"], ["user", "assistant", "user"], 1),
        (["assistant"], ["user", "assistant"], 1),
        ([None, "assistant"], ["user", "assistant"], 0),
        (["bot"], ["user"], 0),
        (["user", "bot", "user"], ["user", "assistant", "user"], 0),
    ],
)
def test_an_empty_turn_is_cheaper_than_a_false_role(spark, given, want, inserted):
    frame = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(given)], "conv_id long, turn long, role string, text string")
    out = sorted(chat.formatted(frame).collect(), key=lambda r: r.turn)
    assert [r for r, _ in read_back(out)[1]] == want
    assert sum(r.inserted for r in out) == inserted
    assert all(r.role == g for r, g in zip(out, given) if g in chat.ROLES)
    # No other legal repair costs as little.
    known = [chat.ROLES.index(g) + 1 if g in chat.ROLES else 0 for g in given]
    costs = [c for roles in itertools.product((1, 2, 3), repeat=len(known)) if (c := cost_of(known, roles)) is not None]
    assert inserted == 0 or costs.count(min(costs)) == 1


def test_what_the_system_says_is_no_answer(spark):
    """Between two user turns, a system turn is merged into them."""
    frame = spark.createDataFrame(
        [(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("system", "be brief"), ("user", "b"), ("assistant", "c")])],
        "conv_id long, turn long, role string, text string",
    )
    assert read_back(chat.formatted(frame).collect())[1] == [("user", "a\nbe brief\nb"), ("assistant", "c")]


@pytest.mark.parametrize("turn", ["CAST(7 AS LONG)", "CAST(NULL AS LONG)"])
def test_turns_of_one_number_are_many_chunks(spark, monkeypatch, turn):
    """All turns of a conversation have one number or none, a third of them equal; no chunk gets longer for it."""
    monkeypatch.setattr(chat, "CHUNK", 16)
    text = "IF(id % 3 = 0, 'same', concat('t', id))"
    frame = spark.range(600).selectExpr("CAST(1 AS LONG) AS conv_id", f"{turn} AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", f"{text} AS text")
    rows = chat.sorted_turns(frame)
    assert max(r["count"] for r in rows.groupBy(*chat.KEYS).count().collect()) <= 16
    out = sorted(chat.formatted(frame).collect(), key=lambda r: r.place)
    assert len({r.place for r in out}) == 600
    whole = "".join(r.piece for r in out)
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", whole, re.S)
    # Equal numbers are ordered by role: all the user's come first, then all the assistant's.
    assert [r for r, _ in turns] == ["user", "assistant"]
    assert sorted(" ".join(t for _, t in turns).split()) == sorted("same" if k % 3 == 0 else f"t{k}" for k in range(600))


def test_no_conversation_is_none_of_the_named(spark):
    """Rows without conv_id are a conversation of their own, beside those numbered -1 and 0."""
    frame = spark.createDataFrame(
        [(c, t, r, f"{c} {t}") for c in (None, -1, 0) for t, r in ((None, "system"), (-1, "user"), (0, "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    back = defaultdict(list)
    for r in sorted(chat.formatted(frame).collect(), key=lambda r: r.place):
        back[r.conv_id].append((r.turn, r.role, r.piece))
    assert set(back) == {None, -1, 0}
    for conv, rows in back.items():
        assert [r[:2] for r in rows] == [(None, "system"), (-1, "user"), (0, "assistant")]
        assert rows[-1][2] == f"<|end|>\n<|assistant|>\n{conv} 0<|end|>\n"
