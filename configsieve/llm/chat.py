"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation from a user turn on, at least one.  Every turn gets a legal role;
turns may be merged into the turn before (of the same role), relabelled, or
preceded by an empty turn.  A null or unknown role has to be replaced whatever it
becomes, so relabelling weighs only against known roles; an empty turn before an
assistant's is cheaper than giving a turn a role that is false.  What somebody
else said is no answer to learn from and no rule to obey: a known role may only
become the user's, which is always enough.
Dynamic programming over the automaton of legal turns finds the cheapest repair,
and the repaired conversation is rendered.

A conversation may be as long as the corpus, so it is cut into chunks of rows of
the sorted table, whatever their turn numbers.  A chunk is a matrix: the least
cost from each state before it to each state after it.  Per conversation only
these small matrices are put in order; each chunk is then solved between the
states that are on the cheapest way.  The result is one row per turn with its
piece of the rendered text; the pieces of a conversation in the order of `place`
are the rendered sequence.

Edge cases: null and unknown roles have to be relabelled; a null text is empty;
turns of equal number are ordered by role and text; repeated rows are turns of
their own; null turns come first; rows without conv_id are one conversation, with
a null conv_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm.ngram_join import bounds, groups
from configsieve.llm.storage import settled

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 1, 4, 2
#: Rows of a chunk at most.
CHUNK = 512
FAR = 1 << 40

#: Ways from a state to a turn of a role: (cost, roles of empty turns put in between, whether merged).
WAYS: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {
    (START, SYSTEM): (0, (), False),
    (START, USER): (0, (), False),
    (START, ASSISTANT): (INSERT, (USER,), False),
    (SYSTEM, SYSTEM): (MERGE, (), True),
    (SYSTEM, USER): (0, (), False),
    (SYSTEM, ASSISTANT): (INSERT, (USER,), False),
    (USER, USER): (MERGE, (), True),
    (USER, ASSISTANT): (0, (), False),
    (ASSISTANT, USER): (0, (), False),
    (ASSISTANT, ASSISTANT): (MERGE, (), True),
}
#: What it costs to stop in a state.  A system turn alone is taken for the user's:
#: with an empty turn after it, nothing would be asked.
STOP = {START: 0, SYSTEM: FAR, USER: 0, ASSISTANT: 0}


def relabelling(role: int, to: int) -> int:
    """What it costs to give a turn of a role (0 where unknown) the role `to`; FAR is no way."""
    if role == to:
        return 0
    return FAR if role and to != USER else RELABEL


def step(role: int) -> np.ndarray:
    """Costs of one turn from each state to each state; `role` 0 is one that has to be relabelled."""
    out = np.full((4, 4), FAR, np.int64)
    for (state, to), (cost, _, _) in WAYS.items():
        out[state, to] = cost + relabelling(role, to)
    return out


STEPS = [step(role) for role in range(4)]


def in_turn(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Least costs of two stretches one after the other."""
    return np.minimum((first[:, :, None] + second[None]).min(1), FAR)


def stretch(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        out = in_turn(out, STEPS[role])
    return out


def assigned(roles: list[int], entry: int, leave: int) -> list[int]:
    """The role of each turn on a cheapest way from state `entry` to state `leave`; the earlier role on ties."""
    costs = [np.where(np.arange(4) == entry, 0, FAR)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + STEPS[role]).min(0), FAR))
    out, state = [], leave
    for k in range(len(roles) - 1, -1, -1):
        out.append(state)
        state = int((costs[k] + STEPS[roles[k]][:, state]).argmin())
    return out[::-1]


def states(matrices: list[np.ndarray]) -> list[int]:
    """The states between stretches on a cheapest way through all of them, from START on."""
    costs = [np.where(np.arange(4) == START, 0, FAR)]
    for matrix in matrices:
        costs.append(np.minimum((costs[-1][:, None] + matrix).min(0), FAR))
    state = int((costs[-1] + np.array([STOP[s] for s in range(4)])).argmin())
    out = [state]
    for k in range(len(matrices) - 1, -1, -1):
        state = int((costs[k] + matrices[k][:, state]).argmin())
        out.append(state)
    return out[::-1]


def opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSED = "<|end|>\n"


def rendered(turns: list[tuple[int, str]], entry: int, last: bool) -> list[tuple[str, int, int]]:
    """(piece, merged, inserted) per turn (role, text) of a chunk that is entered in a state.

    A piece closes the turn before, unless it is merged into it; the very last
    piece closes its own.
    """
    out, state = [], entry
    for k, (role, text) in enumerate(turns):
        _, empty, merged = WAYS[state, role]
        before = "\n" if merged else (CLOSED if state != START else "") + "".join(opened(r) + CLOSED for r in empty) + opened(role)
        after = CLOSED if last and k == len(turns) - 1 else ""
        out.append((before + text + after, int(merged), len(empty)))
        state = role
    return out


def sorted_turns(turns: DataFrame) -> DataFrame:
    """named (whether there is a conv_id), conv, place, chunk, turn, known (the role, 0 where it has to be relabelled) and text.

    The table is sorted in ranges; a place is a row's number, and a chunk what a
    conversation has of CHUNK rows in a row.  So no chunk has more, even where all
    turns have one number or all rows are equal.
    """
    role = F.lit(0)
    for k, name in enumerate(ROLES, 1):
        role = F.when(F.col("role") == name, k).otherwise(role)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").isNotNull().cast("long").alias("named"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"), role.alias("known"), F.xxhash64(text).alias("h"), text.alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["named", "conv", "turn", "known", "h", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "tie")
    ranged = settled(ranged.withColumn("place", F.monotonically_increasing_id()), "chat-turns")
    return ranged.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("long"))


CONVERSATION = ["named", "conv"]
KEYS = [*CONVERSATION, "chunk"]


def chunk_states(rows: DataFrame) -> DataFrame:
    """KEYS, entry and leave (states around the chunk on the cheapest way) and last (the final chunk)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(KEYS)):
            start, known = bounds(batch, len(KEYS)), batch.column("known").to_pylist()
            raw = [stretch(known[lo:hi]).tobytes() for lo, hi in zip(start, start[1:])]
            first = pa.array(start[:-1])
            keys = [batch.column(k).take(first) for k in range(len(KEYS))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(raw, pa.binary())], names=[*KEYS, "costs"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(CONVERSATION)):
            start, raw = bounds(batch, len(CONVERSATION)), batch.column("costs").to_pylist()
            entry, leave, last = [], [], []
            for lo, hi in zip(start, start[1:]):
                way = states([np.frombuffer(x, np.int64).reshape(4, 4) for x in raw[lo:hi]])
                entry += way[:-1]
                leave += way[1:]
                last += [False] * (hi - lo - 1) + [True]
            columns = [pa.array(entry, pa.int32()), pa.array(leave, pa.int32()), pa.array(last, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEYS)], *columns], names=[*KEYS, "entry", "leave", "last"])

    dealt = rows.select(*KEYS, "place", "known").repartition(*KEYS).sortWithinPartitions(*KEYS, "place")
    costs = dealt.mapInArrow(fold, "named long, conv long, chunk long, costs binary")
    dealt = costs.repartition(*CONVERSATION).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(solve, "named long, conv long, chunk long, entry int, leave int, last boolean")


FORMATTED = (
    "conv_id long, turn long, place long, role string, relabelled boolean, merged boolean, inserted int, piece string"
)


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn (see FORMATTED): its repaired role and its piece of the rendered conversation.

    `place` orders the turns of a conversation; it has gaps.
    """
    rows = sorted_turns(turns)
    joined = rows.join(settled(chunk_states(rows), "chat-states"), KEYS)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, len(KEYS)):
            start, known = bounds(batch, len(KEYS)), batch.column("known").to_pylist()
            text, entry, leave, last = (batch.column(c).to_pylist() for c in ("text", "entry", "leave", "last"))
            out: list[tuple] = []
            for lo, hi in zip(start, start[1:]):
                roles = assigned(known[lo:hi], entry[lo], leave[lo])
                pieces = rendered(list(zip(roles, text[lo:hi], strict=True)), entry[lo], last[lo])
                for k, (role, (piece, merged, inserted)) in enumerate(zip(roles, pieces, strict=True)):
                    out.append((ROLES[role - 1], role != known[lo + k], bool(merged), inserted, piece))
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            names = [field.split()[0] for field in FORMATTED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "place")), *columns], names=names)

    conv_id = F.when(F.col("named") == 1, F.col("conv")).alias("conv_id")
    dealt = joined.select(*KEYS, "place", conv_id, "turn", "known", "text", "entry", "leave", "last")
    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "place").mapInArrow(render, FORMATTED)
