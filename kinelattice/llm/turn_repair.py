"""Repair of conversation structure: the cheapest edits that give a legal order of turns.

A repaired conversation's roles have the initials ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of
user and assistant. Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty
turn of user or assistant 2; a turn that is truncated and not deleted adds 1. Blank and repeated turns must go. Of
equally cheap repairs the one whose edits, by their initials in order (D, I, K, R), are least in ASCII is taken.

Four states say what is out so far: nothing, the system turn, a user turn, a whole pair. The dynamic programme runs on
tensors with time first: conversations are bucketed by length, and one NumPy step per turn updates the costs of all
states of all conversations of a bucket. It goes backwards, so what is stored for each turn is the least cost of all
that follows; the edits are traced forwards with it, again one step per turn for all conversations.

In Spark this is one shuffle by conversation and two sorted streams over it. The backward stream reads turns from the
last to the first and adds the costs as a column, the forward stream reads them in order and gives the edits. A
conversation that is longer than a chunk goes on in the next one from four costs (backwards) or one state (forwards), so
memory is bounded by the chunk, however long a conversation is. One conversation is one sorted run in one task, as its
digest needs its turns in order.

Edge cases: a null role or text counts as one space (so the text is blank and the role fits nowhere); null turns come
first; turns with one number go by role, then text; rows with a null conv_id are one conversation; an empty role has no
initial and fits nowhere, it can only be changed or deleted; roles count by their first character, so ``system`` and
``sys`` are alike; very long texts travel whole; other columns are not read, so their names never clash; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.session import importable

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_FAR = 1 << 60
#: States: 0 nothing, 1 the system turn, 2 a user turn is open, 3 a whole pair. By state, the one after a new turn ...
_NEXT = np.array([2, 2, 3, 2])
#: ... and after a turn kept with the initial s, u, a or another (4: not possible).
_KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_ROLE = np.array(["", "", "user", "assistant"])
#: Rows and bytes of text that a task holds at once.
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 4 << 20
_TURN = "conv_id bigint, pos bigint, turn bigint, role string, text string, fault string, code int"
_EDIT = "conv_id bigint, pos bigint, turn bigint, edit string, role string, text string, was string, fault string, cost bigint"


# damage, for tests and for training a model of it -------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4
    makes it a user's. Nulls are one space in the checksum, roles and texts.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "kind")


# faults -------------------------------------------------------------------------------------------------------------


def _code(role: Column, fault: Column) -> Column:
    """Initial's class, plus 4 for a truncated turn and 8 for one that must go."""
    first = F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return kind + F.when(fault == "truncated", 4).when(fault.isNotNull(), 8).otherwise(0)


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role, text, fault, code: turns by conversation in order, with their first fault.

    Blank: no character but ASCII white space. Duplicate: an earlier turn has the same role and text. Truncated: the last
    character that is no white space ends no sentence. All windows share the shuffle by conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "nth")).cast("bigint") - 1)
    last = F.substring(F.rtrim(F.regexp_replace("text", "[\\x09-\\x0D]", " ")), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    return rows.select("conv_id", "pos", "turn", "role", "text", "fault", _code(F.col("role"), F.col("fault")).cast("int").alias("code"))


# the dynamic programme ----------------------------------------------------------------------------------------------


def _choices(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [n, state] of deleting, keeping and rerolling turns with ``code``, given the costs ``after`` them."""
    wide = np.concatenate([after, np.full((len(after), 1), _FAR)], axis=1)
    extra = ((code >> 2) & 1)[:, None] + np.where(code & 8, _FAR, 0)[:, None]
    keep = np.take_along_axis(wide, _KEPT[code & 3], axis=1) + KEEP + extra
    return after + DELETE, keep, after[:, _NEXT] + REROLE + extra


def _insert(cost: np.ndarray) -> np.ndarray:
    """Costs [n, state] where new turns may come first."""
    out = cost.copy()
    out[:, 2] = np.minimum(cost[:, 2], cost[:, 3] + INSERT)
    out[:, 3] = np.minimum(cost[:, 3], cost[:, 2] + INSERT)
    out[:, :2] = np.minimum(cost[:, :2], out[:, 2:3] + INSERT)
    return out


#: Costs behind the last turn: nothing and whole pairs are legal ends.
END = _insert(np.array([[0, _FAR, _FAR, 0]]))[0]


def _buckets(length: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the conversations of like length (within a factor of two)."""
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for k in np.unique(size):
        yield np.flatnonzero(size == k)


def backward(code: np.ndarray, start: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs behind each turn [row, state] and before the first turn [conversation, state].

    Conversation i has the rows from ``start[i]`` on, ``length[i]`` of them; ``end[i]`` are the costs behind its last one.
    """
    after, first = np.zeros((len(code), 4), np.int64), end.copy()
    for own in _buckets(length):
        steps, n = int(length[own].max()), length[own]
        cost = end[own]
        for t in range(steps - 1, -1, -1):
            live = np.flatnonzero(n > t)
            row = start[own[live]] + t
            after[row] = cost[live]
            cost[live] = _insert(np.minimum.reduce(_choices(cost[live], code[row])))
        first[own] = cost
    return after, first


def forward(code: np.ndarray, after: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before each row, its inserts and edit as a number, state behind each conversation).

    The number is ten times the inserts, plus 1 for keep, 2 for rerole, 3 for delete.
    """
    before, edit, last = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), state.copy()
    for own in _buckets(length):
        n = length[own]
        at = state[own]
        for t in range(int(n.max())):
            live = np.flatnonzero(n > t)
            row, now = start[own[live]] + t, at[live]
            before[row] = now
            drop, keep, role = _choices(after[row], code[row])
            best, spot = _insert(np.minimum.reduce((drop, keep, role))), np.arange(len(live))
            done = np.zeros(len(live), np.int64)
            for inserts in range(3):  # no cheapest repair inserts more than two turns at one place
                open_ = done == 0
                goal, there = best[spot, now], now
                gone = open_ & (drop[spot, there] == goal)
                new = open_ & ~gone & (best[spot, _NEXT[there]] + INSERT == goal)
                kept = open_ & ~gone & ~new & (keep[spot, there] == goal)
                rest = open_ & ~gone & ~new & ~kept
                done = np.where(gone, 3 + 10 * inserts, np.where(kept, 1 + 10 * inserts, np.where(rest, 2 + 10 * inserts, done)))
                now = np.where(new, _NEXT[there], np.where(kept, _KEPT[code[row] & 3, there], np.where(rest, _NEXT[there], now)))
            edit[row], at[live] = done, now
        last[own] = at
    return before, edit, last


# streams ------------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of some batches: at most about ``most`` rows and ``CHUNK_BYTES`` of text, or one batch."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(conv: pa.ChunkedArray) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids of the conversations in a chunk, where each starts and how long it is."""
    ids = np.asarray(conv.fill_null(0))
    null = np.asarray(conv.is_null())
    start = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
    return [None if null[k] else int(ids[k]) for k in start], start, np.diff(np.append(start, len(ids)))


def _costs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds ``after`` to turns that come from the last to the first of each conversation."""
    carried: tuple | None = None  # (conversation, costs before its first turn so far)
    for table in _chunks(batches, most):
        ids, start, length = _runs(table.column("conv_id"))
        code = np.asarray(table.column("code")).astype(np.int64)[::-1]  # in order of time, conversations reversed
        end = np.repeat(END[None], len(ids), axis=0)
        if carried and carried[0] == (ids[0],):
            end[0] = carried[1]
        after, first = backward(code, len(code) - start - length, length, end)
        carried = ((ids[-1],), first[-1])
        flat = pa.array(after[::-1].ravel(), pa.int64())
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * 4), flat)
        yield from table.append_column("after", column).to_batches()


def _edits(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edits of turns that come in order."""
    open_: list | None = None  # conversation, state, last position
    for table in _chunks(batches, most):
        ids, start, length = _runs(table.column("conv_id"))
        state = np.zeros(len(ids), np.int64)
        rows: list[tuple] = []
        if open_ is not None and open_[0] == ids[0]:
            state[0] = open_[1]
        elif open_ is not None:
            rows += _tail(*open_)
        code = np.asarray(table.column("code")).astype(np.int64)
        after = np.asarray(table.column("after").combine_chunks().flatten()).reshape(-1, 4)
        before, edit, last = forward(code, after, start, length, state)
        ends = dict(zip((start + length - 1).tolist(), range(len(ids))))
        fields = zip(*(table.column(c).to_pylist() for c in ("conv_id", "pos", "turn", "role", "text", "fault")))
        size = 0
        for k, (conv, pos, turn, role, text, fault) in enumerate(fields):
            now, (inserts, what) = int(before[k]), divmod(int(edit[k]), 10)
            for _ in range(inserts):
                now = int(_NEXT[now])
                rows.append((conv, pos, None, "I", str(_ROLE[now]), "", None, None, INSERT))
            cut = int(fault == "truncated")
            if what == 1:
                rows.append((conv, pos, turn, "K", role, text, role, fault, KEEP + cut))
            elif what == 2:
                rows.append((conv, pos, turn, "R", str(_ROLE[_NEXT[now]]), text, role, fault, REROLE + cut))
            else:
                rows.append((conv, pos, turn, "D", None, None, role, fault, DELETE))
            if k in ends and ends[k] < len(ids) - 1:
                rows += _tail(conv, int(last[ends[k]]), pos)
            size += len(text)
            if size > CHUNK_BYTES or len(rows) > most:
                yield _rows(rows, _EDIT)
                rows, size = [], 0
        open_ = [ids[-1], int(last[-1]), pos]
        if rows:
            yield _rows(rows, _EDIT)
    if open_ is not None and (rows := _tail(*open_)):
        yield _rows(rows, _EDIT)


def _tail(conv: int | None, state: int, pos: int) -> list[tuple]:
    """New turns behind the last one: what completes a pair."""
    out = []
    while state in (1, 2):
        state = int(_NEXT[state])
        out.append((conv, pos + 1, None, "I", str(_ROLE[state]), "", None, None, INSERT))
    return out


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in ddl.split(", ")))
    kind = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The edits of every conversation in order: conv_id, pos, turn, edit, role, text, was, fault, cost.

    ``edit`` is K, R, D or I. ``role`` and ``text`` are those of the repaired turn (NULL for a deleted one), ``was`` is the
    role before and NULL for a new turn. The repaired conversation is all rows but the deleted ones. Rows of a partition
    stay in order; a global order is (conv_id, pos, with new turns first).
    """
    importable(conversations.sparkSession)
    turns = faults(conversations)
    costs = turns.sortWithinPartitions("conv_id", F.col("pos").desc()).mapInArrow(lambda own: _costs(own, chunk_rows), f"{_TURN}, after array<bigint>")
    return costs.sortWithinPartitions("conv_id", "pos").mapInArrow(lambda own: _edits(own, chunk_rows), _EDIT)


class _Report:
    """Counts and digests of one conversation, from its edits in order."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, []
        self.low = self.high = self.initial = None
        self.turns = self.out = 0
        self.sha = hashlib.sha256()

    def add(self, turn: int | None, edit: str, role: str | None, text: str | None, was: str | None, fault: str | None, cost: int) -> None:
        self.cost += cost
        self.audit.append(edit)
        if was is not None:
            if fault:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.out else ''}{role}:{text}".encode())
            self.out += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


_REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Report | None = None
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "was", "fault", "cost"))
        for conv, *edit in zip(*columns):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = _Report(conv)
            now.add(*edit)
        if done:
            yield _rows(done, _REPORT)
    if now:
        yield _rows([now.row()], _REPORT)


def report(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults, cost, edits and the repaired conversation's digest.

    ``edits`` is what :func:`repair` returns, in the order that it has; conversations without a turn have zeros, no edits
    and the digest of the empty string.
    """
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    got = edits.mapInArrow(_reports, _REPORT).withColumnRenamed("conv_id", "own")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(got, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
