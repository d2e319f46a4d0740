"""Ranked search against scoring every document, and block boundaries against every way to cut a list."""

import collections
import math
import random
import re

import numpy as np
import pytest

from kinelattice.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, term string, df long, score long"
ITEMS = "item_id long, text string, rank string, doc_id long"


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    words = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(t for _, w in words for t in set(w))
    wanted = collections.defaultdict(list)
    for i, t in items:
        wanted[i] += split(t)
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, w in words:
            m = 25 + (75 * len(w) * n_docs) // total if total else 0
            tf = collections.Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, "r", 3) for i, t in items], ITEMS)
    return sorted(map(tuple, ranked_search.rank_documents(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(rng, n, words):
    hot = ["the", "Of", "and"]
    return [" ".join(rng.choice(hot) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("size", [(1 << 15, 1 << 22), (40, 1 << 22), (1 << 15, 500)])
def test_equals_scoring_everything(spark, size):
    rng = random.Random(size[0])
    words = [f"w{k}" for k in range(300)] + ["é", "Éa", "straße", "x9"]
    docs = list(enumerate(texts(rng, 400, words)))
    docs += [(5, "w1 w2 twice"), (5, "w1 w2 twice"), (None, "w1 w2 twice"), (None, "w1 w2 twice"), (700, None), (701, ""), (702, " -- "), (703, "w1 " * 200000), (704, "a\x00w1_W2")]
    items = [(k, t) for k, t in enumerate(texts(rng, 25, words))] + [(90, "w1 w2 W2 w2 twice"), (91, None), (92, "absent"), (None, "w5 the"), (93, "w7"), (93, "w8 w8"), (94, "the of and")]
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(3)
    pairs = ranked_search.item_terms(spark.createDataFrame([(i, t, "r", 3) for i, t in items], ITEMS))
    index = ranked_search.build_index(d, shard_docs=size[0], shard_words=size[1])  # all terms
    got = sorted(map(tuple, ranked_search.search(index, pairs, pass_terms=100).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    assert run(spark, docs, items) == want


def test_ties_go_by_doc_id(spark):
    docs = [(k, "same words in every text") for k in range(100, 0, -1)] + [(200, "none of them")]
    assert run(spark, docs, [(1, "same text")], 7) == brute(docs, [(1, "same text")])


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a b")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def cheapest(x, fixed):
    best = [(0.0, [])]
    for t in range(1, len(x) + 1):
        best.append(min((best[j][0] + (t - j) * max(x[j:t]) + fixed, [*best[j][1], t]) for j in range(max(0, t - ranked_search.WIDEST), t)))
    return best[-1]


def test_boundaries_are_the_cheapest():
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 1000, n) for n in (1, 2, 3, 7, 64, 65, 200, 1000)] + [np.full(300, 5)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ends = ranked_search.boundaries(np.concatenate(lists), start, 8.0)
    for x, a, b in zip(lists, start, start[1:]):
        own = ends[(ends > a) & (ends <= b)] - a
        assert own[-1] == len(x)
        cost = sum((e - s) * x[s:e].max() + 8.0 * x.mean() for s, e in zip([0, *own], own))
        assert cost == pytest.approx(cheapest(x.tolist(), 8.0 * x.mean())[0])


def test_long_lists_and_large_counts():
    x = np.random.default_rng(1).integers(1, 9, 5000)
    ends = ranked_search.boundaries(x, np.array([0, 5000]), 8.0)
    assert set(range(1024, 5000, 1024)) <= set(ends.tolist()) and ends[-1] == 5000
    tf, length = np.array([3]), np.array([10**7])
    assert ranked_search.impacts(tf, length, 10**13, 10**15)[0] == (3 * 10**9) // (3000 + 8 * (25 + 75 * 10**7 * 10**13 // 10**15))


def test_blocks_are_skipped(monkeypatch):
    """A rare term lifts the threshold, after which the common term's low blocks are not read."""
    read = []
    rng = np.random.default_rng(0)
    docs = 20000
    post = [np.arange(docs), np.array([50, 9000])]
    impact = np.concatenate([np.where(np.arange(docs) % 4000 < 20, 900, rng.integers(1, 20, docs)), [999, 990]]).astype(np.int32)
    start = np.array([0, docs, docs + 2])
    ends = ranked_search.boundaries(impact, start, 8.0)
    shard = object.__new__(ranked_search._Shard)
    shard.start, shard.post, shard.impact = start, np.concatenate(post).astype(np.int32), impact
    begins = np.concatenate([[0], ends[:-1]])
    shard.block_at, shard.block_start, shard.block_max = np.searchsorted(begins, start), np.append(begins, docs + 2), np.maximum.reduceat(impact, begins)
    shard.first, shard.last = shard.post[shard.block_start[:-1]], shard.post[shard.block_start[1:] - 1]
    shard.doc_id, shard.terms = np.arange(docs), {b"common": 0, b"rare": 1}
    old = ranked_search._Shard._score

    def score(self, docs, *more):
        read.append(len(docs))
        return old(self, docs, *more)

    monkeypatch.setattr(ranked_search._Shard, "_score", score)
    found, scores = shard.best([(b"common", 2), (b"rare", 300)], 10)
    total = np.zeros(docs, np.int64)
    total += 2 * impact[:docs].astype(np.int64)
    total[post[1]] += 300 * impact[docs:].astype(np.int64)
    want = np.lexsort((np.arange(docs), -total))[:10]
    assert found.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert sum(read) < docs / 10


def test_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op13_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
