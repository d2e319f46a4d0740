"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language in every task and adds the packed count blocks by (language, block). The
log-probability matrix, languages x buckets, is broadcast; a batch of texts is a sparse row-compressed matrix (document
bounds, buckets, unit counts) that is multiplied with it one language at a time. With more languages than ``group`` the
matrix is broadcast and multiplied group by group, each pass keeping a text's best language and the sum over all so far,
so neither the driver nor a task holds more than one group of rows and the answers are the same.

The score is the posterior of the predicted language: prior and n-gram log-probabilities are added as they are.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be
learned; ties go to the first language by name; repeated rows get equal answers; a very long text is a batch of its own
and read whole; an empty table gives no rows, and one to learn from no languages; other columns are not read, so their
names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.llm.textcols import in_chunks
from kinelattice.session import cut, importable

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
BLOCK = 1 << 10
_LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter counts as a space.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def _grams(bodies: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start of each text among the characters of all, and for each n-gram order the bucket at each character.

    Texts are lower-cased and stand between spaces. Bucket BUCKETS marks a place whose n-gram would leave its text.
    """
    padded = [f" {b.decode('utf-8', 'replace').lower()} " if b else "  " for b in bodies]
    size = np.array([len(t) for t in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).copy()
    plain = code < 128
    code[plain] = _FOLD[code[plain]]
    end = np.cumsum(size)
    out, h = [], np.zeros(len(code), np.uint32)
    for n in ORDERS:
        h = h * np.uint32(0x01000193)
        if n > 1:
            h[: 1 - n] += code[n - 1 :]
        else:
            h += code
        mixed = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        at = (mixed >> np.uint32(16)).astype(np.int32)
        for k in range(1, n):
            at[end - k] = BUCKETS
        out.append(at)
    return end - size, out


#: Languages that a task counts before it hands its counts on.
HELD = 64


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            cells = n[:BUCKETS].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells)), pa.array(range(len(cells)), pa.int32()), pa.array([rows[lang] if k == 0 else 0 for k in range(len(cells))], pa.int64()), pa.array([x.tobytes() for x in cells])],
                ["lang", "block", "rows", "counts"],
            )
        total.clear()
        rows.clear()

    for part in in_chunks(batches, "body"):
        langs = part.column("lang").to_pylist()
        bodies = part.column("body").to_pylist()
        for lang in set(langs):
            own = [b for b, x in zip(bodies, langs) if x == lang]
            _, grams = _grams(own)
            into = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for at in grams:
                into += np.bincount(at, minlength=BUCKETS + 1)
            rows[lang] = rows.get(lang, 0) + len(own)
            if len(total) >= HELD:
                yield from flush()
    yield from flush()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, block), added up one block after the other."""
    at, rows, total = None, 0, np.zeros(BLOCK, np.int64)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([rows], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([total.tobytes()])], ["lang", "block", "rows", "grams", "counts"])

    for b in batches:
        for lang, block, n, counts in zip(*(b.column(k).to_pylist() for k in range(4))):
            if (lang, block) != at:
                if at:
                    yield done()
                at, rows, total = (lang, block), 0, np.zeros(BLOCK, np.int64)
            rows += n
            total += np.frombuffer(counts, np.int64)
    if at:
        yield done()


@dataclass
class Model:
    """The languages in order with their log-priors and n-grams, and the table of counts (lang, block, counts)."""

    langs: list[str]
    prior: np.ndarray
    grams: np.ndarray
    counts: DataFrame | None
    smoothing: float

    def rows(self, low: int, high: int) -> Rows:
        """The log-probabilities of languages ``low`` to ``high`` - 1."""
        own = self.langs[low:high]
        logp = np.zeros((len(own), BUCKETS + 1), np.float32)
        at = {x: k for k, x in enumerate(own)}
        for r in self.counts.filter(F.col("lang").between(own[0], own[-1])).toLocalIterator():
            block = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            n = np.frombuffer(r["counts"], np.int64) + self.smoothing
            logp[at[r["lang"]], block] = np.log(n / (self.grams[low + at[r["lang"]]] + self.smoothing * BUCKETS))
        return Rows(own, self.prior[low:high], logp)


@dataclass
class Rows:
    """Some languages of a model; the last column, for places without an n-gram, is 0."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def weigh(self, bodies: list[bytes | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """For each text the best of these languages (None without a letter), its logit, and the log-sum of all logits."""
        best: list[str | None] = [None] * len(bodies)
        top, both = np.full(len(bodies), -np.inf), np.full(len(bodies), -np.inf)
        lettered = [k for k, b in enumerate(bodies) if b and _LETTER.search(b.decode("utf-8", "replace"))]
        if lettered:
            start, grams = _grams([bodies[k] for k in lettered])
            total = np.zeros((len(self.langs), len(lettered)))
            for k in range(len(self.langs)):
                total[k] = self.prior[k] + sum(np.add.reduceat(self.logp[k][at], start, dtype=np.float64) for at in grams)
            first = total.argmax(0)
            top[lettered] = total.max(0)
            both[lettered] = top[lettered] + np.log(np.exp(total - total.max(0)).sum(0))
            for k, x in zip(lettered, first):
                best[k] = self.langs[x]
        return best, top, both


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Fit on all rows with a language. The driver keeps each language's name and two numbers; counts stay in a table."""
    importable(rows.sparkSession)
    known = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("body"))
    blocks = known.mapInArrow(_count, "lang string, block int, rows bigint, counts binary").repartition("lang", "block").sortWithinPartitions("lang", "block")
    counts = cut(blocks.mapInArrow(_add, "lang string, block int, rows bigint, grams bigint, counts binary"), "language-counts")
    found = sorted(counts.groupBy("lang").agg(F.sum("rows").alias("rows"), F.sum("grams").alias("grams")).collect())
    n = np.array([r["rows"] for r in found], float)
    return Model([r["lang"] for r in found], np.log(n / n.sum()) if found else n, np.array([r["grams"] for r in found], float), counts, smoothing)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", group: int = 256) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language)."""
    importable(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out, keep, state = f"doc_id {kind}, lang_pred string, score double", f"doc_id {kind}, body binary", "best string, top double, both double"

    def step(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_chunks(batches, "body"):
                own = shared.value.weigh(part.column("body").to_pylist())
                if "top" in part.schema.names:  # earlier languages by name come first in ties
                    before, top, both = part.column("best").to_pylist(), part.column("top").to_numpy(), part.column("both").to_numpy()
                    best = [x if b > a else w for a, b, w, x in zip(top, own[1], before, own[0])]
                    own = best, np.maximum(top, own[1]), np.logaddexp(both, own[2])
                best, top, both = own
                if last:
                    some = np.isfinite(top)
                    score = np.where(some, np.exp(np.where(some, top, 0.0) - np.where(some, both, 0.0)), 0.0)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x or "und" for x in best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(best, pa.string()), pa.array(top), pa.array(both)], ["doc_id", "body", "best", "top", "both"])

        return run

    if not model.langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for low in range(0, len(model.langs), group):
        shared, last = spark.sparkContext.broadcast(model.rows(low, low + group)), low + group >= len(model.langs)
        rows = rows.mapInArrow(step(shared, last), out if last else f"{keep}, {state}")
        rows = rows if last else cut(rows, "language-group")
    return rows
