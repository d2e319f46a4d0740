"""Quality rules with an isolation forest over rule statistics.

Statistics of each whole text (words are runs of non-white-space bytes) feed two judges. The base rules reject short
texts and texts made of repeated 3-word windows. The forest isolates points by random splits; a short mean path marks
an anomaly. Its reject threshold is calibrated on all labelled rows that pass the base rules.

Bounds: the forests are fitted on at most ``fit_rows`` labelled rows (lowest hash of doc_id first; of the bad ones
among them so many that they make up ``contamination``); calibration counts
every labelled row in ``BINS`` score bins. Edge cases: a null or empty text has all statistics 0 and fails the base
rules; without labels of both kinds, the method rejects nothing; repeated rows get equal verdicts; of ties between
thresholds the middle one is taken, and of labels of one doc_id the lesser; a very long text is a chunk of its own and
read whole; other columns stay or are not read (names that begin with ``_kl_`` are the module's own); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinelattice.llm.textcols import ASCII_SPACE, in_chunks, texts
from kinelattice.session import cut, importable

SYMBOLS = b"#*$%&|<>"
BINS = 2000
_CONT = bytes(range(0x80, 0xC0))
_UPPER, _DIGIT, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?\"'()[]{}:;=@\\^_`~/+-"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_bare", "n_distinct")
_STATS = pa.schema([pa.field("doc_id", pa.int64()), *(pa.field(c, pa.int64()) for c in (*COUNTS, *EXTRA))])
_DDL = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in (*COUNTS, *EXTRA))


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # keep the triple inside 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def text_stats(body: bytes | None) -> tuple[int, ...]:
    """COUNTS then EXTRA for one text."""
    if not body:
        return (0,) * (len(COUNTS) + len(EXTRA))
    words = body.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = [x for x in body.split(b"\n") if x.strip(ASCII_SPACE)]
    size = len(body)
    bare = np.fromiter((not w.strip(SYMBOLS + _MARKS + b".,") for w in number), bool, len(number))
    lack = lambda drop: size - len(body.translate(None, drop))
    return (
        len(words), len(body.translate(None, ASCII_SPACE + _CONT)), lack(SYMBOLS), len(lines) - len(set(lines)), _repeated(ids, len(number)),
        len(lines), lack(_UPPER), lack(_DIGIT), lack(_MARKS), int(bare[ids].sum()), len(number),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in in_chunks(batches, "body"):
        rows = np.array([text_stats(b) for b in part.column("body").to_pylist()], np.int64).reshape(part.num_rows, -1)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], schema=_STATS)


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).mapInArrow(_stats, _DDL)


def base_failed(n_words, n_repeat_words):
    """Works on columns and on numpy arrays."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Columns of ``features`` that one forest judges together: wording and symbols, repetition, letter case and marks.
GROUPS = ([0, 1, 7], [2, 3], [4, 5, 6])


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as rates, one row per document."""
    words, chars, lines = (np.maximum(x[c], 1).astype(float) for c in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        x["word_chars"] / words, x["n_symbols"] / words, x["n_dup_lines"] / lines, x["n_repeat_words"] / words, x["n_upper"] / chars,
        x["n_digits"] / chars, x["n_marks"] / words, x["n_bare"] / words,
    ])


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at leaves), split value, left child (right is left + 1), leaf path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, at or under 0.5 for ordinary points."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, f] >= value[at]))
            total += path[at]
        return 2.0 ** (-total / (len(self.feature) * self.norm))


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def fit_forest(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, value = np.full((trees, size), -1), np.zeros((trees, size))
    left, path = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), sample, replace=False)], 0)], 1
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if level == depth or len(part) <= 1 or not len(free):
                path[t, node] = level + _expected(len(part))
                continue
            f = int(rng.choice(free))
            v = rng.uniform(low[f], high[f]) or high[f]
            right = part[:, f] >= v
            feature[t, node], value[t, node], left[t, node] = f, v, used
            todo += [(used, part[~right], level + 1), (used + 1, part[right], level + 1)]
            used += 2
    return Forest(feature, value, left, path, max(_expected(sample), 1e-9), depth)


@dataclass
class Verdict:
    """For each group of features its forest and the score from which a document is rejected. Without any, all stay."""

    judges: list[tuple[list[int], Forest, float]]

    def kept(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Verdicts, and how far the worst group's score lies above its threshold (-1 without forests)."""
        kept = ~base_failed(x["n_words"], x["n_repeat_words"])
        excess = np.full(len(kept), -1.0)
        rates = features(x)
        for which, forest, threshold in self.judges:
            excess = np.maximum(excess, forest.score(rates[:, which]) - threshold)
        return kept & (excess < 0), excess


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, *EXTRA)}


def calibrate(labelled: DataFrame, fit_rows: int = 8192, trees: int = 100, sample: int = 256, seed: int = 7, false_reject: float = 0.003, contamination: float = 0.02) -> Verdict:
    """Fit a forest for each group on ``labelled`` (statistics plus quality 0/1) and choose its threshold.

    Among thresholds that reject at most ``false_reject`` of the good rows, the one with the largest gap between the
    rejected shares of bad and good rows; a group where no threshold rejects more bad rows than good ones is left out.
    """
    use = labelled.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & F.col("quality").isin(0, 1))
    fit = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toPandas()
    if fit["quality"].nunique() < 2:
        return Verdict([])
    good, bad = fit[fit["quality"] == 1], fit[fit["quality"] == 0]
    fit = pd.concat([good, bad.head(max(8, round(contamination * len(good))))])  # a dense cluster of bad rows would hide itself
    rates = features({c: fit[c].to_numpy() for c in (*COUNTS, *EXTRA)})
    forests = [(which, fit_forest(rates[:, which], trees, sample, seed + k)) for k, which in enumerate(GROUPS)]
    shared = use.sparkSession.sparkContext.broadcast(forests)  # trees x 2 * sample nodes each: a fixed size

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(_columns(b))
            for k, (which, forest) in enumerate(shared.value):
                at = np.minimum((forest.score(x[:, which]) * BINS).astype(np.int32), BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), b.column("quality").cast(pa.int32())], ["which", "bin", "quality"])

    rows = use.select(*COUNTS, *EXTRA, "quality").mapInArrow(binned, "which int, bin int, quality int").groupBy("which", "bin", "quality").count().collect()
    count = np.zeros((len(forests), 2, BINS + 1))
    for r in rows:
        count[r["which"], r["quality"], r["bin"]] += r["count"]
    above = count[:, :, ::-1].cumsum(2)[:, :, ::-1]  # rows at or above each bin's lower edge
    judges = []
    for (which, forest), rate in zip(forests, above / np.maximum(above[:, :, :1], 1)):
        gain = np.where(rate[1] <= false_reject, rate[0] - rate[1], -1.0)
        if gain.max() > 0:
            best = np.flatnonzero(gain == gain.max())
            judges.append((which, forest, float(best[len(best) // 2]) / BINS))  # the middle of the gap between the kinds
    return Verdict(judges)


def _labelled(own: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return own.join(known, "doc_id")


def fit_verdict(docs: DataFrame, labels: DataFrame, **params) -> tuple[Verdict, DataFrame]:
    """The calibrated verdict and the statistics of all documents (written once, small rows)."""
    own = cut(stats(docs), "quality-stats")
    return calibrate(_labelled(own, labels), **params), own


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, anomaly (the forest's score)."""
    verdict, own = fit_verdict(docs, labels, **params)
    shared = docs.sparkSession.sparkContext.broadcast(verdict)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _columns(b)
            kept, score = shared.value.kept(x)
            failed = base_failed(x["n_words"], x["n_repeat_words"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *COUNTS)), pa.array(failed), pa.array(kept), pa.array(score)], [*("doc_id", *COUNTS), "base_failed", "kept", "anomaly"])

    return own.mapInArrow(judge, f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Every text is parsed once: its statistics travel with the row, and the verdict is found and applied row by row.
    """
    importable(docs.sparkSession)
    names = [f"_kl_{c}" for c in (*COUNTS, *EXTRA)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, "text"):
            rows = np.array([text_stats(b) for b in part.column("text").cast(pa.binary()).to_pylist()], np.int64).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(rows[:, k]) for k in range(len(names)))], [*part.schema.names, *names])

    own = cut(docs.mapInArrow(measure, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in names)])), "quality-rows")
    verdict = calibrate(_labelled(own.select("doc_id", *(F.col(c).alias(c.removeprefix("_kl_")) for c in names)), labels), **params)
    shared = docs.sparkSession.sparkContext.broadcast(verdict)
    columns = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b.column(f"_kl_{c}").to_numpy(zero_copy_only=False) for c in (*COUNTS, *EXTRA)}
            yield b.select(columns).filter(pa.array(shared.value.kept(x)[0]))

    return own.mapInArrow(judge, docs.schema)
