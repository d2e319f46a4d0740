"""Ranked lexical search: an inverted index in shards with variable posting blocks, and exact block-skipping search.

A document's score for an item is the sum over the item's terms, repeats included, of a weight that falls with the number
of documents that hold the term, times an *impact* of the term's count and the document's length, all in 64-bit whole
numbers but for the weight's logarithm.

**Index.** Documents are indexed where they are read: a task gathers shards of at most ``SHARD_DOCS`` documents and
``SHARD_WORDS`` words, so texts are not shuffled and no posting list is ever longer than its shard. Corpus counts come
from the written shards; then every shard's posting lists get their impacts and are cut into blocks. A block stores its
greatest impact as a bound for its postings. *Where* lists are cut is chosen by dynamic programming: the boundaries
minimise the sum of all bound errors (greatest impact minus own impact) plus ``block_cost`` average impacts for each
block. The programme runs over many lists at once, one NumPy step per posting position, with blocks of at most
``WIDEST`` postings; lists are cut at every ``SEGMENT`` postings in any case and it is exact between these.

**Search.** For an item, the block boundaries of its terms divide a shard's documents into runs in which every list
stands in one block or in none, so that the sum of weighted block bounds, WAND's test of a pivot, holds for all documents
of a run. Runs are tried from the highest bound down; once ``k`` documents are found, runs whose bound is below the
k-th score are skipped. In the others a document is scored only if it stands in a pivot list, one that the remaining
lists' bounds need to reach the k-th score, and only blocks that reach over such a document are read. What is skipped
cannot reach the result, so it is exact. A shard gives its best ``k`` for each item; they meet in one window by item, which
keeps ``k`` rows per task before its shuffle.

Items are searched in passes of at most about ``PASS_TERMS`` (item, term) pairs, which are all that is broadcast.

Edge cases: null texts and texts without a term are in no list and not counted; a text of any length is one document in
one task; equal scores go by ascending doc_id, null last; rows that repeat a doc_id are documents of their own; rows that
repeat an item_id (null is one) are one item with the terms of all of them; items without a hit have no row; other
columns are not read, so their names never clash; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.llm.textcols import in_chunks, texts
from kinelattice.session import cut, drop, importable

SHARD_DOCS, SHARD_WORDS = 1 << 15, 1 << 22
SEGMENT, WIDEST = 1024, 64
PASS_TERMS = 1 << 18
#: With more different terms in the items than this, an index for them holds all terms.
MOST_TERMS = 1 << 20
#: Characters outside of terms to spaces, A-Z to lower case; bytes of other characters stay.
_FOLD = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GATHERED = "doc_id array<bigint>, length binary, terms array<binary>, df array<bigint>, start binary, post binary, tf binary, n_docs bigint, n_terms bigint"
_INDEX = "doc_id array<bigint>, terms array<binary>, start binary, post binary, impact binary, block_at binary, block_start binary, block_max binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Index:
    """``shards``: one row per shard; ``df`` (term, df): documents that hold a term; N and L of the corpus."""

    shards: DataFrame
    df: DataFrame
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        drop(self.shards)
        drop(self.df)


# building -----------------------------------------------------------------------------------------------------------


class _Gather:
    """Documents of a shard to be."""

    def __init__(self, only: frozenset[bytes] | None):
        self.only, self.ids, self.doc, self.length, self.words, self.size = only, {}, [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        self.doc.append(doc_id)
        self.length.append(len(words))
        if self.only is not None:
            words = [w for w in words if w in self.only]
        ids = self.ids
        self.words.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
        self.size += len(words)

    def row(self) -> dict:
        n = len(self.doc)
        order = sorted(range(n), key=lambda k: (self.doc[k] is None, self.doc[k] or 0))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        found, tf = np.unique(np.concatenate(self.words) * n + np.repeat(rank, [len(w) for w in self.words]), return_counts=True)
        df = np.bincount(found // n, minlength=len(self.ids))
        length = np.array(self.length, np.int64)
        return {
            "doc_id": [self.doc[k] for k in order], "length": length[order].tobytes(), "terms": list(self.ids), "df": df.tolist(), "start": np.concatenate([[0], np.cumsum(df)]).astype(np.int64).tobytes(),
            "post": (found % n).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(), "n_docs": int((length > 0).sum()), "n_terms": int(length.sum()),
        }


def _gather(docs: DataFrame, only: frozenset[bytes] | None, shard_docs: int, shard_words: int) -> DataFrame:
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Gather(wanted.value if wanted else None)
        for batch in in_chunks(batches, "body"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                now.add(doc_id, text or b"")
                if len(now.doc) >= shard_docs or now.size >= shard_words:
                    yield _one(now.row(), _GATHERED)
                    now = _Gather(now.only)
        if now.doc:
            yield _one(now.row(), _GATHERED)

    return docs.mapInArrow(run, _GATHERED)


_KINDS = {"array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "binary": pa.binary(), "bigint": pa.int64()}


def _one(row: dict, ddl: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], _KINDS[k]) for n, k in fields], [n for n, _ in fields])


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's part of the score before its term's weight."""
    exact = length.astype(object) if len(length) and 75 * int(length.max()) * n_docs >= 1 << 63 else length
    m = (25 + (75 * exact * n_docs) // max(n_terms, 1)).astype(np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def boundaries(impact: np.ndarray, start: np.ndarray, block_cost: float) -> np.ndarray:
    """Ends of the blocks of all lists, ascending; list i has the postings from ``start[i]`` to ``start[i + 1]``."""
    size = np.diff(start)
    if not len(impact):
        return np.zeros(0, np.int64)
    fixed = np.zeros(len(size))
    fixed[size > 0] = block_cost * np.add.reduceat(impact, start[:-1][size > 0]) / size[size > 0]
    parts = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = start[owner] + nth * SEGMENT
    long = np.minimum(SEGMENT, start[owner + 1] - at)
    ends = [np.zeros(0, np.int64)]
    scale = np.ceil(np.log2(np.maximum(long, 1))).astype(int)
    for k in np.unique(scale):
        for own in np.array_split(np.flatnonzero(scale == k), -(-int((scale == k).sum()) << int(k) >> 20) or 1):
            ends.append(_cuts(impact, at[own], long[own], fixed[owner[own]]))
    return np.sort(np.concatenate(ends))


def _cuts(impact: np.ndarray, at: np.ndarray, long: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Block ends of segments of like length: the cheapest way to end at each position, from those up to ``WIDEST`` before."""
    n, steps = len(at), int(long.max())
    widest = min(WIDEST, steps)
    cost = np.full((n, steps + widest), np.inf)  # column t + widest - 1: the cheapest blocks over the first t postings
    cost[:, widest - 1] = 0
    width = np.arange(widest, 0, -1)
    back = np.zeros((n, steps), np.int16)
    greatest = np.zeros((n, widest))  # of the last widest, ..., 2, 1 postings
    for t in range(steps):
        x = np.where(t < long, impact[np.minimum(at + t, len(impact) - 1)], 0)[:, None]
        greatest[:, :-1] = greatest[:, 1:]
        greatest[:, -1] = 0
        np.maximum(greatest, x, out=greatest)
        way = cost[:, t : t + widest] + width * greatest
        best = way.argmin(axis=1)
        back[:, t] = width[best]
        cost[:, t + widest] = way[np.arange(n), best] + fixed
    ends, left = [], long.copy()
    own = np.arange(n)
    while len(own):
        ends.append(at[own] + left[own])
        left[own] -= back[own, left[own] - 1]
        own = own[left[own] > 0]
    return np.concatenate(ends)


def _blocks(shards: DataFrame, n_docs: int, n_terms: int, block_cost: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("doc_id", "terms", "start", "post", "tf", "length")}
                start, post, tf, length = (np.frombuffer(row[c].as_py(), t) for c, t in (("start", np.int64), ("post", np.int32), ("tf", np.int32), ("length", np.int64)))
                impact = impacts(tf, length[post], n_docs, n_terms)
                ends = boundaries(impact, start, block_cost)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
                yield _one(
                    {
                        "doc_id": row["doc_id"].as_py(), "terms": row["terms"].as_py(), "start": row["start"].as_py(), "post": row["post"].as_py(), "impact": impact.astype(np.int32).tobytes(),
                        "block_at": np.searchsorted(begins, start).astype(np.int64).tobytes(), "block_start": np.append(begins, len(post)).astype(np.int64).tobytes(),
                        "block_max": (np.maximum.reduceat(impact, begins) if len(begins) else impact).astype(np.int32).tobytes(),
                    },
                    _INDEX,
                )

    return shards.mapInArrow(run, _INDEX)


def build_index(docs: DataFrame, only: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", block_cost: float = 8.0, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> Index:
    """Index every row of ``docs``; with ``only``, just the posting lists of these terms (the counts stay those of all)."""
    shards = cut(_gather(texts(docs, id_col, text_col), only, shard_docs, shard_words), "search-shards")
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    both = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = cut(both.groupBy("term").agg(F.sum("df").alias("df")), "search-df")
    index = cut(_blocks(shards, n_docs, n_terms, block_cost), "search-index")
    drop(shards)
    return Index(index, df, n_docs, n_terms)


# searching ----------------------------------------------------------------------------------------------------------


class _Shard:
    def __init__(self, batch: pa.RecordBatch, k: int):
        arrays = {"start": np.int64, "post": np.int32, "impact": np.int32, "block_at": np.int64, "block_start": np.int64, "block_max": np.int32}
        for name, kind in arrays.items():
            setattr(self, name, np.frombuffer(batch.column(name)[k].as_buffer(), kind))
        self.doc_id = batch.column("doc_id")[k].values
        self.terms = {t: i for i, t in enumerate(batch.column("terms")[k].values.to_pylist())}
        self.first, self.last = self.post[self.block_start[:-1]], self.post[self.block_start[1:] - 1]

    def best(self, terms: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the best documents for weighted terms, best first, and equal scores by number."""
        own = [(self.terms[t], w) for t, w in terms if t in self.terms]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.concatenate([np.arange(self.block_at[t], self.block_at[t + 1]) for t, _ in own])
        weight = np.repeat(np.array([w for _, w in own], np.int64), [self.block_at[t + 1] - self.block_at[t] for t, _ in own])
        first, last = self.first[blocks], self.last[blocks]
        edges = np.unique(np.concatenate([first, last + 1]))
        bound = np.zeros(len(edges), np.int64)
        np.add.at(bound, np.searchsorted(edges, first), self.block_max[blocks] * weight)
        np.subtract.at(bound, np.searchsorted(edges, last + 1), self.block_max[blocks] * weight)
        bound = np.cumsum(bound)[:-1]
        runs = np.argsort(-bound, kind="stable")
        runs = runs[bound[runs] > 0]
        covered = np.cumsum(np.diff(edges)[runs])
        docs, scores, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while done < len(runs):
            least = scores[-1] if len(scores) == k else 1
            if bound[runs[done]] < least:
                break
            more = max(int(np.searchsorted(covered, (covered[done - 1] if done else 0) + step)), done) + 1
            more = min(more, int(np.searchsorted(-bound[runs], -least, side="right")))
            some = self._candidates(edges, runs[done:more], own, int(least))
            found, score = self._score(some, blocks, weight, first, last)
            docs, scores = np.concatenate([docs, found]), np.concatenate([scores, score])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores, done, step = docs[top], scores[top], more, step * 4
        return docs, scores

    def _candidates(self, edges: np.ndarray, runs: np.ndarray, own: list[tuple[int, int]], least: int) -> np.ndarray:
        """Documents of ``runs`` that stand in a list without which the others' bounds in the run stay below ``least``.

        This is WAND's pivot: of a run's lists by ascending bound, those whose sum is too small can't make a hit alone,
        so only the blocks of the other lists are read here.
        """
        block = np.zeros((len(own), len(runs)), np.int64)
        bound = np.zeros((len(own), len(runs)), np.int64)
        for i, (t, w) in enumerate(own):
            a, b = self.block_at[t], self.block_at[t + 1]
            at = np.minimum(np.searchsorted(self.last[a:b], edges[runs]), b - a - 1) + a
            block[i] = at
            bound[i] = np.where((self.first[at] <= edges[runs]) & (self.last[at] >= edges[runs]), self.block_max[at].astype(np.int64) * w, 0)
        order = np.argsort(bound, axis=0, kind="stable")
        enough = np.cumsum(np.take_along_axis(bound, order, axis=0), axis=0) >= least
        pivot = np.zeros_like(enough)
        np.put_along_axis(pivot, order, enough, axis=0)
        pivot &= bound > 0
        doc, at = self._read(np.unique(block[pivot]))
        spot = np.full(len(edges), -1)
        spot[runs] = np.arange(len(runs))
        run = spot[np.searchsorted(edges, doc, side="right") - 1]
        lists = np.array([t for t, _ in own])
        rank = np.searchsorted(self.start, at, side="right") - 1
        place = np.argsort(lists, kind="stable")
        which = place[np.searchsorted(lists[place], rank)]
        return np.unique(doc[(run >= 0) & pivot[which, run]])

    def _read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, places) of the postings of some blocks."""
        begin = self.block_start[blocks]
        count = self.block_start[blocks + 1] - begin
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        return self.post[at], at

    def _score(self, docs: np.ndarray, blocks: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whole scores of ``docs``; only blocks that reach over one of them are read."""
        met = np.flatnonzero(np.searchsorted(docs, last, side="right") > np.searchsorted(docs, first))
        doc, at = self._read(blocks[met])
        count = self.block_start[blocks[met] + 1] - self.block_start[blocks[met]]
        spot = np.minimum(np.searchsorted(docs, doc), max(len(docs) - 1, 0))
        keep = docs[spot] == doc if len(docs) else np.zeros(len(doc), bool)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, spot[keep], self.impact[at[keep]] * np.repeat(weight[met], count)[keep])
        return docs[total > 0], total[total > 0]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, repeats) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "body"):
            words = [terms_of(t or b"") for t in batch.column("body").to_pylist()]
            ids = np.repeat(np.arange(batch.num_rows), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), pa.array([x for w in words for x in w], pa.binary())], ["item_id", "term"])

    rows = texts(items.withColumn("_kl_item", F.col(id_col).cast("bigint")), "_kl_item", text_col)
    return rows.mapInArrow(run, "item_id bigint, term binary").groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def search(index: Index, pairs: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item; ``pairs`` is what :func:`item_terms` gives."""
    importable(pairs.sparkSession)
    context = pairs.sparkSession.sparkContext
    held = pairs.join(index.df, "term")
    passes = max(1, -(-held.count() // pass_terms))
    found = []
    for n in range(passes):
        rows = held.filter(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(passes)) == n).orderBy("item_id").collect()  # pass_terms pairs or so
        items: dict[int | None, list] = {}
        for r in rows:
            if w := weight(index.n_docs, r["df"]):
                items.setdefault(r["item_id"], []).append((bytes(r["term"]), w * r["repeats"]))
        found.append(_pass(index.shards, context.broadcast(items), k))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(shards: DataFrame, items, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch, i)
                ids, docs, scores = [], [], []
                for item, terms in items.value.items():
                    doc, score = shard.best(terms, k)
                    ids += [item] * len(doc)
                    docs.append(doc)
                    scores.append(score)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), shard.doc_id.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_cost: float = 8.0) -> DataFrame:
    """The ``k`` best documents for every item, over an index of the items' terms in all documents."""
    pairs = cut(item_terms(items), "search-items")
    words = pairs.select("term").distinct()
    known = words.count()
    only = frozenset(bytes(r[0]) for r in words.collect()) if known <= MOST_TERMS else None
    index = build_index(docs, only, block_cost=block_cost)
    out = cut(search(index, pairs, k), "search-best")
    index.drop()
    drop(pairs)
    return out
