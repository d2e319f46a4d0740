"""Best-fit packing by exact-complement hashing.

Distinct words are tokenized once for the corpus (see ``distinct_words``). Texts, long ones too, become token pieces of
at most ``capacity`` tokens, with the ids that the library gives by its defaults: its added tokens (``<|endoftext|>``)
have their own ids in a text. Which lengths share a sequence depends on the histogram of lengths alone, at most
``capacity`` numbers, so it is solved once on the driver however many pieces there are: a piece opens a sequence, and an
index of single, pair and triple sums of the available lengths finds combinations that fill its gap exactly, taken as
often as their counts allow; what has no exact complement is placed by best fit, the least gap left. Ties: the complement of fewest pieces,
then the one with the largest piece (pairs) or the least (triples). The plan is a list of patterns with multiplicities. Pieces find their place by rank within their length, computed from counts by
(length, task), so a length that a third of all pieces share is never gathered.

Edge cases: a null or empty text is one piece of the end token; repeated rows are packed each; doc_id may be null; other
columns are not read, so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinelattice.llm.distinct_words import encode_words
from kinelattice.session import cut

CAPACITY = 2048
#: The tokenizer of each file, read once in each process.
_loaded: dict[str, tuple[Tokenizer, re.Pattern | None, dict[bytes, bytes]]] = {}


def _vocabulary(path: str) -> tuple[Tokenizer, re.Pattern | None, dict[bytes, bytes]]:
    """The tokenizer, a pattern for its added tokens, and their ids."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if t.normalized or t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"added tokens that depend on their surroundings: {odd}")
        by_length = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        marks = re.compile(b"(" + b"|".join(map(re.escape, by_length)) + b")") if added else None
        tokenizer.encode_special_tokens = True  # the words' own letters; added tokens are taken out of the text before
        _loaded[path] = tokenizer, marks, {b" " + t.content.encode(): np.array([k], "<u4").tobytes() for k, t in added.items()}
    return _loaded[path]


def _splitter(path: str):
    """Words in lower case (A-Z), as the tokenizer takes them: fewer distinct ones.

    Added tokens of the vocabulary are found in the text as it is, as the library does; a leading space, which no word
    has, tells them apart.
    """

    def split(body: bytes) -> list[bytes]:
        marks = _vocabulary(path)[1]
        if marks is None or not marks.search(body):
            return body.lower().split()
        out: list[bytes] = []
        for k, part in enumerate(marks.split(body)):
            out += [b" " + part] if k % 2 else part.lower().split()
        return out

    return split


def _encoder(path: str):
    """Ids of white-space separated words.

    The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in order.
    """

    def make():
        tokenizer, _, added = _vocabulary(path)

        def encode(words: list[bytes]) -> list[bytes]:
            plain = [w for w in words if w not in added]
            ids = iter(tokenizer.encode_batch_fast([w.decode() for w in plain], add_special_tokens=False))
            return [added[w] if w in added else array("I", next(ids).ids).tobytes() for w in words]

        return encode

    return make


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint, ids binary"


def _piecer(end_id: int, capacity: int, keep_ids: bool):
    def finisher():
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4")

        def finish(doc_id: int | None, ids: np.ndarray) -> list[tuple]:
            body, rows = np.concatenate([ids, end]).astype("<u4").tobytes(), []
            for k, at in enumerate(range(0, len(body), 4 * capacity)):
                own = body[at : at + 4 * capacity]
                n = len(own) // 4
                rows.append((doc_id, k, at // 4, n, zlib.crc32(own), task, seen[n], own if keep_ids else None))
                seen[n] += 1
            return rows

        return finish

    return finisher


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all texts; ``rank`` numbers the pieces of one length within one task."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return encode_words(docs, _splitter(path), _encoder(path), _piecer(end_id, capacity, keep_ids), _DDL, _PIECE, kinds, block_bytes=24 << 20)


class _Lengths:
    """Available pieces by length, with an index of the sums of one, two and three of them.

    Counts only fall, so a combination that its sum has passed over never becomes available again: the index holds, for
    each sum, how far its combinations are used up, and a look-up goes on from there.
    """

    def __init__(self, count: np.ndarray):
        self.count: list[int] = np.asarray(count).tolist()
        self.pair_at: dict[int, int] = {}  # the larger length of the next pair
        self.triple_at: dict[int, int] = {}  # the least length of the next triple
        self.below = list(range(len(self.count)))  # the next sum, from here down, that may still be found

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            self.count[n] -= times

    def times(self, pattern: tuple[int, ...]) -> int:
        return min(self.count[n] // pattern.count(n) for n in set(pattern))

    def single(self, total: int) -> tuple[int] | None:
        return (total,) if self.count[total] else None

    def _pair_from(self, total: int, a: int, beside: tuple[int, ...] = ()) -> int:
        """The next larger member, from ``a`` down, of a pair that is available together with ``beside``."""
        while 2 * a >= total and not self.times((a, total - a, *beside)):
            a -= 1
        return a

    def pair(self, total: int) -> tuple[int, int] | None:
        a = self.pair_at[total] = self._pair_from(total, self.pair_at.get(total, min(total, len(self.count)) - 1))
        return (a, total - a) if 2 * a >= total else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        for c in range(self.triple_at.get(total, 1), total // 3 + 1):
            if self.count[c] and (got := self.pair(total - c)):
                a = self._pair_from(total - c, got[0], (c,))
                if 2 * a >= total - c:
                    self.triple_at[total] = c
                    return (c, a, total - c - a)
        self.triple_at[total] = total
        return None

    def complement(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that fill ``gap`` exactly or, where none do, leave the least of it."""
        total = gap
        while total:
            while self.below[total] != total:  # over the sums that are used up
                self.below[total] = total = self.below[self.below[total]]
            if not total or (got := self.single(total) or self.pair(total) or self.triple(total)):
                break
            self.below[total] = total - 1
        return got if total else ()


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (each at most ``capacity`` in sum) and how often each is used; ``count[n]`` pieces of n tokens.

    The longest piece left opens a sequence, and the index gives what fills its gap exactly; what has no exact complement
    is placed by best fit, the combination that leaves the least gap, until nothing fits. A pattern is repeated as often
    as the counts allow.
    """
    left = _Lengths(count)
    out: list[tuple[tuple[int, ...], int]] = []
    for n in range(capacity, 0, -1):
        while left.count[n]:
            pattern, gap, more = (n,), capacity - n, (n,)
            left.take(more, 1)
            while more := left.complement(gap):
                left.take(more, 1)
                pattern, gap = pattern + more, gap - sum(more)
            again = left.times(pattern)
            left.take(pattern, again)
            out.append((pattern, 1 + again))
    return out


class Places:
    """For each length, intervals of ranks and where they go."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for n in pattern:
                by.setdefault(n, []).append((used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + times
                offset += n
            sequence += times
        self.sequences = sequence
        self.by = {n: np.array(x, np.int64) for n, x in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            at = self.by[n][np.searchsorted(self.by[n][:, 0], rank[own], "right") - 1]
            sequence[own], offset[own] = at[:, 1] + rank[own] - at[:, 0], at[:, 2]
        return sequence, offset


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    own = cut(pieces(docs, path, end_id, capacity, keep_ids), "pieces")
    by_task = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        count[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(count, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = own.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *(["ids"] if keep_ids else []))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            ids = [b.column("ids")] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset), *ids], [*names, "sequence_id", "offset", *(["ids"] if keep_ids else [])])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids binary" if keep_ids else ""))
