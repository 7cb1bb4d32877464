"""Repair of conversations by weighted finite-state composition.

Three machines are composed. The input acceptor reads a conversation's turns in
order. The edit transducer keeps a turn, gives it another role, deletes it or
inserts an empty one, each at its cost. The grammar acceptor takes the role
initials ``(s?(ua)+)?``. Weights are (cost, label string), added and appended,
and the smaller pair wins; the best accepting path is the repair.

States are (turns read, grammar state), in topological order of the turns read.
The composition is lazy: a turn matters only through its class (initial, must it
go, is it cut off), and what the states hold only through their costs and the
order of their strings relative to each other; for each such pair the arcs are
made when first met and remembered. At most two insertions stand between two
turns: more would pass a grammar state twice and cost for nothing.

Strings are compared without being built. A state's string is the one it had
after its last turn, and insertions since. Those after a turn end with a turn's
label and hold equally many, so none is the beginning of another, and their order
(``rank``) never changes by appending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What a turn that is cut off adds unless it is deleted.
CUT_OFF = 1
ROLES = {"u": "user", "a": "assistant"}
#: The grammar: state -> {initial: next state}. START and PAIRS accept.
START, SYSTEM, ASKED, PAIRS = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": PAIRS}, PAIRS: {"u": ASKED}}
INITIALS = {c for arcs_ in GRAMMAR.values() for c in arcs_}
ACCEPTING = (START, PAIRS)
LEGAL = {"su", "ua", "au"}
MOST_INSERTED = 2
#: Rows of conversations in one Arrow batch of the result.
BATCH_TURNS = 20_000

_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Class:
    """All that the machines see of a turn; the initial is empty where it doesn't matter."""

    initial: str
    must_go: bool
    cut_off: bool


def inserted(state: int, n: int) -> tuple[int, str] | None:
    """The state after n inserted turns, and their initials; None if the grammar takes no such turns there."""
    initials = ""
    for _ in range(n):
        found = [(c, to) for c, to in GRAMMAR[state].items() if c in ROLES]
        if not found:
            return None
        (c, state), *_ = found
        initials += c
    return state, initials


def arcs(of: Class, state: int) -> Iterator[tuple[str, str, int, int]]:
    """(label, initial, next state, cost) of the ways to read a turn in a grammar state."""
    yield DELETE, "", state, COSTS[DELETE]
    if of.must_go:
        return
    for c, to in GRAMMAR[state].items():
        if c == of.initial:
            yield KEEP, c, to, COSTS[KEEP] + CUT_OFF * of.cut_off
        if c in ROLES:
            yield REROLE, c, to, COSTS[REROLE] + CUT_OFF * of.cut_off


class Repair:
    """The lazily composed machine; remembers what it has expanded."""

    def __init__(self):
        #: (costs and ranks, class) -> (costs and ranks, added cost, where each state comes from)
        self.known: dict[tuple, tuple] = {}

    def expand(self, held: tuple, of: Class) -> tuple:
        """``held``: (state, cost, rank) of the reached states, costs from the least on."""
        best: dict[int, tuple] = {}
        for state, cost, rank in held:
            for n in range(MOST_INSERTED + 1):
                if (between := inserted(state, n)) is None:
                    continue
                for label, initial, to, more in arcs(of, between[0]):
                    found = (cost + n * COSTS[INSERT] + more, (rank, INSERT * n + label), state, between[1], label, initial)
                    if to not in best or found < best[to]:
                        best[to] = found
        least = min(x[0] for x in best.values())
        ranks = {key: i for i, key in enumerate(sorted({x[1] for x in best.values()}))}
        now = tuple((to, x[0] - least, ranks[x[1]]) for to, x in sorted(best.items()))
        return now, least, {to: x[2:] for to, x in best.items()}

    def __call__(self, classes: list[Class]) -> tuple[int, list[tuple[str, str]]]:
        """(cost, edits of the best path as (label, initial of the turn that results))."""
        held, total, steps = ((START, 0, 0),), 0, []
        for of in classes:
            key = held, of
            if key not in self.known:
                self.known[key] = self.expand(held, of)
            held, added, back = self.known[key]
            total += added
            steps.append(back)
        ends = []
        for state, cost, rank in held:
            for n in range(MOST_INSERTED + 1):
                if (between := inserted(state, n)) and between[0] in ACCEPTING:
                    ends.append((cost + n * COSTS[INSERT], (rank, INSERT * n), state, between[1]))
        cost, _, state, initials = min(ends)
        edits = [(INSERT, c) for c in reversed(initials)]
        for back in reversed(steps):
            state, initials, label, initial = back[state]
            edits.append((label, initial))
            edits += [(INSERT, c) for c in reversed(initials)]
        return total + cost, edits[::-1]


def text_of(c: Column) -> Column:
    """As text; a null is one space."""
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) of conversations' rows after the damage that the hash of their place deals.

    ``gone`` marks dropped rows, which stay here so that no conversation is lost.
    """
    hashed = F.crc32(F.concat_ws(":", text_of(F.col("conv_id")), text_of(F.col("turn"))).cast("binary")) % 20
    base = rows.select("conv_id", "turn", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"), hashed.alias("damage"))
    d = F.col("damage")
    return base.select(
        "conv_id",
        "turn",
        F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d <= 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (d == 0).alias("gone"),
    )


class _Counts:
    """The faults of one conversation, and its turns' classes."""

    def __init__(self):
        self.classes: list[Class] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.seen: set[tuple[str, str]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut_off: bool, known: dict) -> None:
        again = (role, text) in self.seen
        self.seen.add((role, text))
        self.blank += blank
        self.duplicate += again and not blank
        must_go = blank or again
        cut_off = cut_off and not must_go
        self.truncated += cut_off
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last:  # turns come in order
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        key = role[:1] if not must_go and role[:1] in INITIALS else "", must_go, cut_off
        self.classes.append(known.get(key) or known.setdefault(key, Class(*key)))
        self.roles.append(role)
        self.texts.append(text)

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0

    def repaired(self, edits: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, label) of the turns that result."""
        turns = zip(self.roles, self.texts)
        for label, initial in edits:
            if label == INSERT:
                yield ROLES[initial], "", label
                continue
            role, text = next(turns)
            if label != DELETE:
                yield ROLES[initial] if label == REROLE else role, text, label


_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repairs(kind: pa.DataType):
    def run(batches):
        machine, known = Repair(), {}
        ids, numbers, audits, offsets, turns = [], [[] for _ in _NUMBERS], [], [0], ([], [], [])

        def close(conv, c: _Counts) -> None:
            cost, edits = machine(c.classes)
            ids.append(conv)
            for column, v in zip(numbers, (c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost)):
                column.append(v)
            audits.append("".join(label for label, _ in edits))
            for turn in c.repaired(edits):
                for column, v in zip(turns, turn):
                    column.append(v)
            offsets.append(len(turns[0]))

        def flush() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in turns], fields=list(_TURN)))
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, pa.int64()) for c in numbers], pa.array(audits, pa.string()), lists], ["conv_id", *_NUMBERS, "audit", "repaired"])
            for column in (ids, *numbers, audits, *turns):
                column.clear()
            offsets[:] = [0]
            return out

        here, c = None, None
        for batch in batches:
            for conv, turn, gone, role, text, blank, cut_off in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if c is None or conv != here:
                    if c is not None:
                        close(here, c)
                        if offsets[-1] >= BATCH_TURNS:
                            yield flush()
                    here, c = conv, _Counts()
                if not gone:
                    c.add(turn, role, text, blank, cut_off, known)
        if c is not None:
            close(here, c)
            yield flush()

    return run


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text, copy, gone), as ``damaged`` gives them.

    Columns: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired,
    the turns that result (role, text and the edit that made them). Turns are read
    by number, nulls first; of equal numbers by role and text. Each conversation is
    read as a stream out of Spark's sort by one task, as its one audit and one
    digest ask for; a task holds one conversation at a time. Null conv_ids are one
    conversation; one without rows, or whose rows all go, has empty turns.
    """
    text = F.rtrim(F.col("text"), F.lit(_SPACE))
    blank = text == ""
    cut_off = ~blank & ~F.substring(text, -1, 1).isin(".", "!", "?")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    kind = rows.schema["conv_id"].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{n} bigint' for n in _NUMBERS)}, audit string, repaired array<struct<role: string, text: string, edit: string>>"
    return arrow_map(dealt.select("conv_id", "turn", "gone", "role", "text", blank.alias("blank"), cut_off.alias("cut_off")), _repairs(arrow), schema)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation, damaged as ``damaged`` says; rules as in ``repaired``."""
    out = repaired(damaged(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", *_NUMBERS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
