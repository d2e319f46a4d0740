"""Chat formatting in budgeted, turn-aligned windows.

A turn is written ``<|turn:ROLE|>\\nTEXT<|end|>\\n``. Control strings inside roles and texts get a backslash after their
first character and backslashes are doubled, so the marks in the output are the template's own and reading back is
exact. Prefix sums of turn tokens choose the spans: a window takes turns while they fit the budget beside the system
turn and a limited history; the history repeats the last turns of the window before. Tokens are those of the written
turn, marks and escapes included; a turn begins with ``<`` after a line end, where no token spans, so they add up. Loss spans cover the assistant
texts of new turns only, so every target counts once.

The rows of a conversation are streamed in turn order with constant state (the current window), so a conversation of
any length needs no memory of its own; its digest needs its turns in order, and different conversations are spread.

A window holds at most the budget, with one exception: where the system turn and one other turn are longer together (or one
of them alone is), the window holds just these, uncut and without history, and ``over_budget`` is true. The system turn is
retained in that case too, so a system turn beyond the budget makes every window of its conversation such a window, with
one turn each.

Edge cases: null roles and texts are empty; ties in ``turn`` go by role, then text; repeated rows are turns of their own; rows with a null
conv_id are one conversation; very long texts are encoded whole, one at a time; other columns are not read, so their
names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.llm.byte_bpe import ranks
from kinelattice.session import importable

#: Strings that chat templates give a meaning; a text must not smuggle one in.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROL) + r")[\s\S]|\\")
_END = "<|end|>\n"
_TURN = re.compile(r"<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
_WINDOW = ["conv_id", "window", "formatted", "loss_start", "loss_end", "repeated", "n_new", "tokens", "over_budget"]
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
_DDL = "conv_id bigint, window int, formatted string, loss_start array<bigint>, loss_end array<bigint>, repeated int, n_new int, tokens bigint, over_budget boolean"


def escape(text: str) -> str:
    """Every control string broken by a backslash after its first character, overlapping ones too; backslashes doubled."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


class _Conversation:
    """The turns of one conversation as they come: what the current window and its history need."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (header, escaped text, is target), history first
        self.ends = [0]  # prefix sums of their tokens
        self.old = self.window = 0

    def _cost(self) -> int:
        return self.ends[-1] - self.ends[0] + (self.system[3] if self.system else 0)

    def _keep_from(self, k: int) -> None:
        self.turns, self.ends = self.turns[k:], self.ends[k:]

    def add(self, role: str, text: str, count: Callable[[str], int]) -> list[tuple]:
        """Take a turn; the window that it closed, if any. ``count`` gives the tokens of what is written."""
        header, body = f"<|turn:{escape(role)}|>\n", escape(text)
        tokens = count(f"{header}{body}{_END}")
        turn = (header, body, role == "assistant", tokens)
        if role == "system" and self.system is None and not self.turns:
            self.system = turn
            return []
        closed = []
        if len(self.turns) > self.old and self._cost() + tokens > self.budget:
            closed = [self.close()]
            spare = min(self.history, self.budget - tokens - (self.system[3] if self.system else 0))
            self._keep_from(min(len(self.turns), bisect_left(self.ends, self.ends[-1] - max(spare, 0))))
            self.old = len(self.turns)
        self.turns.append(turn)
        self.ends.append(self.ends[-1] + tokens)
        return closed

    def close(self) -> tuple:
        """The current window as a row."""
        parts, start, end, at = [], [], [], 0
        lead = [self.system] if self.system else []
        repeated = self.old + (len(lead) if self.window else 0)
        for k, (header, text, target, _) in enumerate([*lead, *self.turns]):
            if target and k >= self.old + len(lead):
                start.append(at + len(header))
                end.append(at + len(header) + len(text))
            parts.append(f"{header}{text}{_END}")
            at += len(parts[-1])
        row = (self.conv_id, self.window, "".join(parts), start, end, repeated, len(parts) - repeated, self._cost(), self._cost() > self.budget)
        self.window += 1
        return row


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def windows(conversations: DataFrame, path: str, pattern: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Training windows: conv_id, window, formatted, loss_start, loss_end, repeated, n_new, tokens, over_budget.

    ``repeated`` leading turns (system turn and history) were in an earlier window already. ``loss_start`` and
    ``loss_end`` are the code-point bounds of the escaped texts under the loss mask.
    """
    importable(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        conv, rows, size = None, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv is None or conv.conv_id != conv_id:
                    rows += [conv.close()] if conv else []
                    conv = _Conversation(conv_id, budget, history)
                done = conv.add(role, text, lambda written: len(encode(written)))
                rows += done
                size += len(text)
                if size > 4 << 20:
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _WINDOW)
                    rows, size = [], 0
        rows += [conv.close()] if conv else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _WINDOW)

    turns = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    return _in_order(turns, "turn", "role", "text").mapInArrow(run, _DDL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first = None, True
        for batch in batches:
            rows = []
            for conv_id, text, starts, ends, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "repeated"))):
                if first or open_[0] != conv_id:
                    rows += [] if first else [open_]
                    open_, first = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], False
                for role, body in parse(text)[repeated:]:
                    open_[1] += 1
                    open_[2].update(f"{role}\n{body}\n".encode())
                for a, b in zip(starts, ends):
                    target = unescape(text[a:b])
                    open_[3] += len(target)
                    open_[4].update(target.encode())
                open_[5] += len(text)
            if rows:
                yield digest(rows)
        if not first:
            yield digest([open_])

    def digest(rows: list[list]) -> pa.RecordBatch:
        done = [(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _in_order(formatted, "window").mapInArrow(run, ddl)
