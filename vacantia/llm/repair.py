"""Repair of conversation structure by depth-first branch and bound.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``.  Its rows are
kept (K, free), given the role that is due (R, 1), deleted (D, 2; blank and repeated rows
must be) or preceded by an empty user or assistant turn (I, 5, at the end as well); a
truncated row that stays costs 5 more.  The cheapest edits are found, of equally cheap ones
those whose letters are least in ASCII order.

The search keeps an explicit stack of (row, grammar state, cost, letters so far).  A node
goes when its cost and the least that the rows after it can cost from its state (letters
left aside, a table from the last row to the first) are above the incumbent, or equal and
its letters are greater; or when the table of its row
and state holds cheaper, or equally cheap and lesser letters.  (Of equally cheap letters
up to one node none is the beginning of the other, as longer ones hold more insertions, so
what is lesser stays lesser.)  An empty stack proves the incumbent.

A conversation of more than BLOCK rows is searched in blocks, from every state that the
ones before can end in to every state, and blocks on which all ways so far agree are
written out: a task holds a few blocks of rows and the letters, never all texts.  Rows are
shuffled by conversation once and sorted on disk where they must be; one conversation is
one task's work, as its digest is one sequence.

Defined results: a null role or text is one space; rows are in order of turn, nulls first,
then of role and text; a row's first fault counts: blank (nothing but white space),
duplicate (role and text seen earlier), truncated (the last character but white space is
none of ``.!?``); other roles count by their first letter, an empty one has none and can't
stay as it is; rows of a null conversation id are one conversation; a conversation whose rows
are all marked as dropped has zeros and nothing left; an empty table gives no rows; other
columns are not looked at; texts of any length stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import by_batch, slices

BLOCK = 256
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT, NEVER = 1, 2, 5, 5, float("inf")


class Row(NamedTuple):
    role: str
    text: str
    fault: int

    @property
    def initial(self) -> str:
        return self.role[:1] or " "


def least(rows: list[Row], goals: tuple[int, ...]) -> list[list[float]]:
    """Least cost of the rows from each one on and each state, to one of ``goals``; letters left aside."""

    def inserted(here: list[float]) -> list[float]:
        for _ in STATES:
            here = [min(c, INSERT + here[DUE[s]]) for s, c in enumerate(here)]
        return here

    out = [inserted([0 if s in goals else NEVER for s in STATES])]
    for row in reversed(rows):
        after, here = out[-1], []
        for s in STATES:
            cost = DELETE + after[s]
            if row.fault not in (BLANK, DUPLICATE):
                stays = min(REROLE + after[DUE[s]], after[AFTER[s, row.initial]] if (s, row.initial) in AFTER else NEVER)
                cost = min(cost, stays + (CUT if row.fault == TRUNCATED else 0))
            here.append(cost)
        out.append(inserted(here))
    return out[::-1]


def search(rows: list[Row], entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost and letters that lead from ``entry`` through all rows to one of ``goals``."""
    n = len(rows)
    rest = least(rows, goals)
    best: tuple[int, str] | None = None
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, letters = stack.pop()
        bound = cost + rest[i][state]
        if bound == NEVER or best and (bound, letters) > (best[0], best[1][: len(letters)]):
            continue
        seen = table[i].get(state)
        if seen and seen <= (cost, letters):
            continue
        table[i][state] = cost, letters
        if i == n and state in goals and (best is None or (cost, letters) < best):
            best = cost, letters
        ways = [(i, DUE[state], cost + INSERT, letters + "I")]
        if i < n:
            row = rows[i]
            ways.append((i + 1, state, cost + DELETE, letters + "D"))
            if row.fault not in (BLANK, DUPLICATE):
                more = cost + (CUT if row.fault == TRUNCATED else 0)
                if (to := AFTER.get((state, row.initial))) is not None:
                    ways.append((i + 1, to, more, letters + "K"))
                ways.append((i + 1, DUE[state], more + REROLE, letters + "R"))
        ways.sort(key=lambda w: (w[2] + rest[w[0]][w[1]], w[3]), reverse=True)  # the most promising on top
        stack += ways
    return best


def replay(rows: list[Row], letters: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """``role, text, letter`` of the turns that the letters make of the rows, and the state after them."""
    out, at = [], 0
    for letter in letters:
        if letter == "I":
            state = DUE[state]
            out.append((ROLE[state], "", letter))
            continue
        row, at = rows[at], at + 1
        if letter == "K":
            state = AFTER[state, row.initial]
            out.append((row.role, row.text, letter))
        elif letter == "R":
            state = DUE[state]
            out.append((ROLE[state], row.text, letter))
    return out, state


class Conversation:
    """One conversation, row by row; ``written`` takes the turns that are certain."""

    def __init__(self, written):
        self.written = written
        self.rows: list[Row] = []
        self.blocks: list[list[Row]] = []  # searched, not yet certain
        self.ways: dict[int, tuple[int, tuple[str, ...]]] = {START: (0, ())}
        self.state, self.cost, self.letters = START, 0, []
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, ""
        self.turns = self.low = self.high = None

    def add(self, turn: int | None, row: Row) -> None:
        if turn is not None:
            if self.turns is None:
                self.turns, self.low = 1, turn
            elif turn != self.high:
                self.turns += 1
            self.high = turn
        self.faults[row.fault] += 1
        if self.last and self.last + row.initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = row.initial
        if len(self.rows) == BLOCK:
            self._advance(STATES)
        self.rows.append(row)

    def _advance(self, goals: tuple[int, ...]) -> None:
        """Search the rows at hand from every state, and write what is certain."""
        ways: dict[int, tuple[int, tuple[str, ...]]] = {}
        for entry, (cost, pieces) in self.ways.items():
            for goal in goals:
                if found := search(self.rows, entry, (goal,)):
                    new = cost + found[0], (*pieces, found[1])
                    if goal not in ways or (new[0], "".join(new[1])) < (ways[goal][0], "".join(ways[goal][1])):
                        ways[goal] = new
        self.ways = ways
        self.blocks.append(self.rows)
        self.rows = []
        while self.blocks and len({w[1][0] for w in self.ways.values()}) == 1:
            self._write(next(iter(self.ways.values()))[1][0])
            self.ways = {s: (c, p[1:]) for s, (c, p) in self.ways.items()}

    def _write(self, letters: str) -> None:
        turns, self.state = replay(self.blocks.pop(0), letters, self.state)
        self.letters.append(letters)
        self.written(turns)

    def end(self) -> None:
        if len(self.ways) == 1 and not self.blocks:  # the usual case: one search
            (entry, (cost, _)), = self.ways.items()
            more, letters = search(self.rows, entry, ENDS)
            self.cost, self.blocks = cost + more, [self.rows]
            self._write(letters)
            return
        self._advance(ENDS)
        self.cost, left = min(self.ways.values(), key=lambda w: (w[0], "".join(w[1])))
        for letters in left:
            self._write(letters)

    @property
    def gaps(self) -> int:
        return 0 if self.turns is None else self.high - self.low + 1 - self.turns


def faulty(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, fault, present``, together by conversation and in order."""
    space = r"[\x20\x09-\x0D]"
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    whole = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, (F.lit(True) if present is None else present).alias("present")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("text").rlike(rf"[.!?]{space}*\z"), TRUNCATED).otherwise(0)
    order = [F.col("turn").asc_nulls_first(), "role", "text", "again"]
    marked = whole.withColumn("again", again).sortWithinPartitions("conv_id", *order)
    return marked.select("conv_id", "turn", "role", "text", fault.alias("fault"), "present")


def conversations(batches: Iterator[pa.RecordBatch], written) -> Iterator[tuple[object, Conversation]]:
    """Conversations of sorted batches, each when its last row has been seen; ``written(id)`` gives what takes its turns."""
    at, current = None, None
    for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
        for conv, turn, role, text, fault, present in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != at:
                if current is not None:
                    current.end()
                    yield at, current
                at, current = conv, Conversation(written(conv))
            if present:
                current.add(turn, Row(role, text, fault))
    if current is not None:
        current.end()
        yield at, current


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, position, role, text, edit``: the turns of every conversation as repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def written(conv):
            place = [0]

            def take(turns):
                for role, text, edit in turns:
                    out.append((conv, place[0], role, text, edit))
                    place[0] += 1

            return take

        for _ in conversations(batches, written):
            if len(out) >= 4096:
                yield _table(out)
                out.clear()
        yield _table(out)

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(rows)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    _table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)
    return by_batch(faulty(rows, present), run, f"conv_id {kind}, position long, role string, text string, edit string")


def report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation: its gaps, faults, least cost, edits, and a digest of the turns of ``repair``."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict[object, tuple] = {}

        def written(conv):
            digest, begun = hashlib.sha256(), [False]
            digests[conv] = digest

            def take(turns):
                for role, text, _ in turns:
                    digest.update(f"{chr(10) if begun[0] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    begun[0] = True

            return take

        out: list[tuple] = []
        for conv, c in conversations(batches, written):
            out.append((conv, c.gaps, *c.faults[1:], c.illegal, c.cost, "".join(c.letters), digests.pop(conv).hexdigest()))
            if len(out) >= 4096:
                yield _table(out)
                out = []
        yield _table(out)

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(rows)), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    _table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, schema.types)], schema=schema)
    return by_batch(faulty(rows, present), run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows dropped, emptied, cut, repeated or given to the user, as a hash of their place says."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("what") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
