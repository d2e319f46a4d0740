"""Removal of repeated 200-byte strings by difference-cover suffix sorting.

A byte goes when a string of ``DEPTH`` bytes that covers it also starts elsewhere in the corpus.

(1) Distribution. Of the ``KMER``-byte words inside each ``DEPTH``-byte string the one with the least hash (the
rightmost of equals) represents it, so equal strings have equal words at equal offsets. Words that occur once in the
corpus cannot lie in a repeat; a bounded bitmap of the others thins the next passes. The surroundings of the other
words meet by word, so all suffixes that could be equal for ``DEPTH`` bytes meet in one task. A word with more than
``GROUP`` surroundings is split: its strings are dealt out by how many bytes they have before the word, in ranges of
``RANGES[level]``, and by the bytes that all strings of such a range share, which are nearly whole strings. Equal strings
still meet, so the split, repeated down to single strings, loses nothing and no task gets a hot word.
(2) Difference cover. The suffixes of each group of words are ranked by a difference cover modulo 3: sampled triples
are sorted and named, the names ranked by recursion (down to ``DEPTH``), the remaining suffixes merged in, and
adjacent prefixes compared. Words with one kind of surroundings need no sort: their copies are all repeats.
(3) The repeated ranges go back to their documents.

Surroundings that are equal inside a chunk of texts travel once, so copies make no hot group. Word hashes only bring
strings together: strings are compared byte by byte, and surroundings are known by 128-bit digests of their bytes.

Edge cases: null and short texts (under ``DEPTH`` bytes) lose nothing; matches never cross documents; repeated rows
are repeats of each other; rows are told apart by doc_id and text, null doc_ids included; very long texts are parsed in
overlapping slices; equal suffixes tie and are repeats of each other whatever their order; other columns are not read, so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.llm import bitmap
from kinelattice.llm.distinct_words import spread
from kinelattice.llm.minhash import mix
from kinelattice.llm.skew import join_groups
from kinelattice.llm.textcols import in_chunks
from kinelattice.session import cut, drop, importable

DEPTH, KMER = 200, 32
_POS = 21
_MASK = (1 << _POS) - 1
#: Texts are parsed in slices of at most so many bytes that overlap by DEPTH - 1, so that positions fit in _POS bits.
_SLICE = 1 << 20
#: Bytes that are parsed together, and surroundings that are sorted together: small arrays stay in the CPU's cache.
_TOGETHER, _SORTED = 1 << 18, 150
#: Surroundings of one word that are sorted in one task, and string starts in a range at each level of a split.
GROUP, RANGES = 2000, (21, 1)
#: Surroundings for one task.
TASK_ROWS = 50_000
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """At least the first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            p = np.full(1 << max(18, (n - 1).bit_length()), np.uint64(base))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each ``length`` bytes of ``data``."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * inverse[: len(data) - length + 1])


def samples(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row, first and last start of the strings it covers, and word hash of every sample."""
    parts, row, base = [], [], []
    for k, body in enumerate(bodies):
        for at in range(0, max(len(body or b"") - DEPTH + 1, 0), _SLICE - DEPTH + 1):
            parts.append(body[at : at + _SLICE])
            row.append(k)
            base.append(at)
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none, none, none
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(parts), np.uint8)
    out = []
    for low, high in _groups(end, size):  # slices together up to the positions' range
        first = end[low] - size[low]
        own = data[first : end[high - 1]]
        h = _window_hashes(own, KMER)
        x = (h & np.uint64(~_MASK & (1 << 64) - 1)) | (np.uint64(_MASK) - np.arange(len(h), dtype=np.uint64))
        span, wide = 1, DEPTH - KMER + 1
        while 2 * span <= wide:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        anchor = np.uint64(_MASK) - (np.minimum(x[: len(own) - DEPTH + 1], x[wide - span : wide - span + len(own) - DEPTH + 1]) & np.uint64(_MASK))
        anchor = anchor.astype(np.int64)
        piece = np.repeat(np.arange(low, high), size[low:high])[: len(anchor)]
        inside = np.arange(len(anchor)) + DEPTH <= (end[piece] - first)
        start = np.flatnonzero(inside)
        anchor, piece = anchor[start], piece[start]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        shift = np.array(base)[piece[new]] - (end[piece[new]] - size[piece[new]] - first)
        out.append((np.array(row)[piece[new]], anchor[new] + shift, start[new] + shift, start[last] + shift, h[anchor[new]].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _groups(end: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of slices of at most _TOGETHER bytes; a longer slice comes alone."""
    low = 0
    for high in range(1, len(end) + 1):
        if high == len(end) or end[high] - (end[low] - size[low]) > _TOGETHER:
            yield low, high
            low = high


def _rows(docs: DataFrame) -> DataFrame:
    importable(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), body.alias("body"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in in_chunks(batches, "body", _TOGETHER):
        yield pa.RecordBatch.from_arrays([pa.array(samples(part.column("body").to_pylist())[4])], ["word"])


def _name(offset: int, around: bytes) -> bytes:
    """Surroundings are their bytes and the place of the word in them."""
    return hashlib.blake2b(offset.to_bytes(4, "little") + around, digest_size=16).digest()


def _surroundings(bodies: list[bytes], repeated: np.ndarray):
    """Samples whose word may be repeated: their columns, the bytes around each and their names."""
    found = samples(bodies)
    keep = np.flatnonzero(bitmap.may_contain(repeated, found[4])) if len(found[4]) else found[0]
    row, at, low, high, word = (c[keep] for c in found)
    around = [bodies[r][a:b] for r, a, b in zip(row.tolist(), low.tolist(), (high + DEPTH).tolist())]
    return row, at, low, word, around, [_name(k, x) for k, x in zip((at - low).tolist(), around)]


_FOUND = "doc_id bigint, key bigint, at bigint, word bigint, name binary, offset int, n bigint, around binary"


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def _find(repeated):
    """Every sample of a possibly repeated word; of equal surroundings in a chunk the first has the bytes and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, "body", 2 * _SLICE):
            row, at, low, word, around, name = _surroundings(part.column("body").to_pylist(), repeated.value)
            first: dict[bytes, int] = {}
            n = np.zeros(len(name), np.int64)
            for k, x in enumerate(name):
                n[first.setdefault(x, k)] += 1
            own = [part.column(c).take(pa.array(row)) for c in ("doc_id", "key")]
            bytes_ = pa.array([x if k else None for x, k in zip(around, n.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(word), pa.array(name, pa.binary()), pa.array((at - low).astype(np.int32)), pa.array(n), bytes_], _names(_FOUND))

    return run


def _sort_bits(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    """Keys that sort like the tuples; every part is below 2**21."""
    key = (a << 21) | b
    return key if c is None else (key << 21) | c


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of ``s`` (symbols from 1, under 2**21) that order their first ``depth`` symbols.

    Difference cover modulo 3: the triples at positions 1 and 2 modulo 3 are sorted and named, the string of names is
    ranked by recursion, and the suffixes at 0 modulo 3 are merged in by (symbol, rank of the next sample). A name
    stands for three symbols, so a third of the depth is enough below.
    """
    n = len(s)
    if depth <= 1 or n < 3:
        return np.searchsorted(np.sort(s), s) if depth <= 1 else np.array(sorted(range(n), key=lambda k: s[k:].tolist())).argsort()
    n0, n2 = (n + 2) // 3, n // 3
    s = np.concatenate([s, np.zeros(3, np.int64)])
    stop = n + (n % 3 == 1)
    sample = np.concatenate([np.arange(1, stop, 3), np.arange(2, stop, 3)])
    if s.max() < 127:  # a name must be under 2**21
        names = ((s[sample] << 14) | (s[sample + 1] << 7) | s[sample + 2]) + 1
        distinct = False
    else:
        unique, names = np.unique(_sort_bits(s[sample], s[sample + 1], s[sample + 2]), return_inverse=True)
        names, distinct = names + 1, len(unique) == len(sample)
    r = np.zeros(n + 3, np.int64)
    r[sample] = names if distinct else suffix_ranks(names, -(-depth // 3)) + 1
    at = [np.arange(k, n, 3) for k in range(3)]
    rank = np.zeros(n, np.int64)
    count = np.bincount(np.concatenate([r[at[1]], r[at[2]]]))
    less = np.cumsum(count) - count
    rank[at[1]], rank[at[2]] = less[r[at[1]]], less[r[at[2]]]
    for other, width in ((1, 1), (2, 2)):  # against samples at 1 modulo 3 by one symbol, at 2 modulo 3 by two
        keys = []
        for k in (0, other):
            key = _sort_bits(s[at[k]], *((r[at[k] + 1],) if width == 1 else (s[at[k] + 1], r[at[k] + 2])))
            order = np.argsort(key)
            keys.append((key[order], at[k][order]))
        (x, at_x), (y, at_y) = keys
        rank[at_x] += np.searchsorted(y, x)
        rank[at_y] += np.searchsorted(x, y)
        if width == 1:
            rank[at_x] += np.searchsorted(x, x)
    return rank


def _repeated_strings(texts: list[bytes]) -> np.ndarray:
    """For each DEPTH-byte string of each text in turn: whether it also starts elsewhere in the texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    strings = size - DEPTH + 1
    joined = np.frombuffer(b"\0".join(texts) + bytes(DEPTH), np.uint8)
    start = np.cumsum(size + 1) - size - 1
    at = np.repeat(start - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    present = np.flatnonzero(np.bincount(joined, minlength=256))
    code = np.zeros(256, np.int64)
    code[present] = np.arange(1, len(present) + 1)
    order = np.argsort(suffix_ranks(code[joined], DEPTH)[at])
    x, y = at[order[:-1]], at[order[1:]]
    same = np.arange(len(x))
    eight = np.ndarray((len(joined) - 7,), "<u8", joined.tobytes(), strides=(1,))
    for k in range(0, DEPTH, 8):  # adjacent prefixes, as far as they agree
        same = same[eight[x[same] + k] == eight[y[same] + k]]
    hit = np.zeros(len(at), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return hit


def _compare(word: np.ndarray, offset: np.ndarray, n: np.ndarray, around: list[bytes]):
    """For each surroundings and maximal run of repeated strings: its row and the removed range, relative to the word."""
    size = np.fromiter(map(len, around), np.int64, len(around))
    strings = size - DEPTH + 1
    first = np.cumsum(strings) - strings
    owner = np.repeat(np.arange(len(size)), strings)
    step = np.arange(strings.sum()) - np.repeat(first, strings)
    lead = offset[owner] - step  # bytes before the word
    hit = (n > 1)[owner]
    alone = np.ones(len(word), bool)  # a word with one surroundings needs no sort
    alone[1:] &= word[1:] != word[:-1]
    alone[:-1] &= word[1:] != word[:-1]
    sort = np.flatnonzero(~alone)
    low = 0
    while low < len(sort):  # groups of whole words; with GROUP surroundings at most, ranks have 21 bits
        high = min(low + _SORTED, len(sort))
        while high < len(sort) and word[sort[high]] == word[sort[high - 1]]:
            high += 1
        own = sort[low:high]
        hit[spread(first[own], strings[own])] |= _repeated_strings([around[j] for j in own.tolist()])
        low = high
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)])
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return owner[first], -lead[first], DEPTH - lead[last]


_MET = "word bigint, name binary, offset int, n bigint, around binary"
_RANGE = "word bigint, name binary, low int, high int, n bigint"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (word, name): whole words together, in groups of bounded size; n is the number of samples."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        word, name, offset, n, around = zip(*rows)
        n = np.array(n, np.int64)
        k, low, high = _compare(np.array(word, np.int64), np.array(offset, np.int64), n, list(around))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(word, np.int64)[k]), pa.array([name[j] for j in k.tolist()], pa.binary()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(n[k])], _names(_RANGE)
        )

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("word", "name", "offset", "n", "around"))):
            if held and r[:2] == held[-1][:2]:  # the same surroundings from another chunk
                held[-1] = (*r[:3], r[3] + held[-1][3], r[4])
                continue
            if len(held) >= 2 * GROUP and r[0] != held[-1][0]:
                yield from flush(held)
                held = []
            held.append(r)
    if held:
        yield from flush(held)


def _light(heavy):
    """Rows whose word is not to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~bitmap.may_contain(heavy.value, b.column("word").to_numpy())))

    return run


_SPLIT = "of_word bigint, of_name binary, word bigint, name binary, offset int, n bigint, around binary"


def _split(heavy, wide: int):
    """The strings of words to be split, ``wide`` starts at a time, under new words made of the bytes that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            b = batch.filter(pa.array(bitmap.may_contain(heavy.value, batch.column("word").to_numpy())))
            for word, name, offset, n, around in zip(*(b.column(c).to_pylist() for c in _names(_MET))):
                last = offset - (len(around) - DEPTH)  # bytes before the word in the last string
                for k in range(last // wide, offset // wide + 1):
                    most, least = min(offset, k * wide + wide - 1), max(last, k * wide)
                    own = around[offset - most : offset - least + DEPTH]
                    shared = around[offset - k * wide : offset - (k * wide + wide - 1) + DEPTH]
                    new = hashlib.blake2b(k.to_bytes(4, "little") + shared, digest_size=8).digest()
                    rows.append((word, name, int.from_bytes(new, "little", signed=True), _name(most, own), most, n, own))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], _names(_SPLIT))

    return run


def _ranges(met: DataFrame, level: int = 0) -> DataFrame:
    """(word, name, low, high, n): the repeated ranges of all surroundings ``met``, relative to their word."""
    spark = met.sparkSession
    large = met.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("word")
    split = level < len(RANGES) and not large.isEmpty()
    if split:
        heavy = spark.sparkContext.broadcast(bitmap.build(large, "word"))
        pieces = cut(met.mapInArrow(_split(heavy, RANGES[level]), _SPLIT), "suffix-split")
        deeper = pieces.groupBy("word", "name").agg(F.min("offset").alias("offset"), F.sum("n").alias("n"), F.min("around").alias("around"), F.count("*").alias("pieces"))
        deeper = cut(deeper, "suffix-pieces")
        below = _ranges(deeper.drop("pieces"), level + 1).groupBy("word", "name").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
        below = cut(below.join(deeper.select("word", "name", "pieces"), ["word", "name"]), "suffix-below")
        back = join_groups(pieces.select("of_word", "of_name", "word", "name", "n"), below, ["word", "name"], "pieces")
        back = back.select(F.col("of_word").alias("word"), F.col("of_name").alias("name"), "n", F.inline("ranges"))
        back = cut(back.groupBy("word", "name", "low", "high").agg(F.sum("n").alias("n")).select(*_names(_RANGE)), "suffix-back")
        for done in (pieces, deeper, below):
            drop(done)
        met = met.mapInArrow(_light(heavy), _MET)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() // TASK_ROWS)
    found = met.repartition(tasks, "word").sortWithinPartitions("word", "name").mapInArrow(_repeats, _RANGE)
    return found.unionByName(back) if split else found


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([z.compress(x) for x in b.column("body").to_pylist()], pa.binary())], ["doc_id", "key", "body"])


def kept_parts(body: bytes, ranges: list[int] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs. ``ranges``: start and end, in turn."""
    spans: list[list[int]] = []
    for a, b in sorted(zip((ranges or [])[::2], (ranges or [])[1::2])):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    ends = [0, *(b for _, b in spans)]
    return b"".join(body[x:y] for x, y in zip(ends, [*(a for a, _ in spans), len(body)])), len(spans)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ranges): for every row with repeats, start and end of removed ranges, in turn, overlapping."""
    rows = _rows(docs)
    spark = docs.sparkSession
    words = rows.select("body").mapInArrow(_words, "word bigint").groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    repeated = spark.sparkContext.broadcast(bitmap.build(words, "word"))
    samples_ = cut(rows.mapInArrow(_find(repeated), _FOUND), "suffix-samples")
    found = _ranges(samples_.filter("n > 0").select(*_names(_MET)))
    found = found.groupBy("word", "name").agg(F.collect_list(F.struct("low", "high")).alias("found"), F.max("n").alias("n"))
    hit = join_groups(samples_.select("doc_id", "key", "at", "word", "name"), cut(found, "suffix-found"), ["word", "name"], "n")
    hit = hit.select("doc_id", "key", F.flatten(F.transform("found", lambda r: F.array(F.col("at") + r["low"], F.col("at") + r["high"]))).alias("range"))
    return hit.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("range")).alias("ranges"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes left (kept)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(docs).toDF("id_r", "key_r", "ranges")
    bodies = _rows(docs).mapInArrow(_compress, "doc_id bigint, key bigint, body binary")
    joined = bodies.join(ranges, F.col("doc_id").eqNullSafe(F.col("id_r")) & (F.col("key") == F.col("key_r")), "left").select("doc_id", "body", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for part in in_chunks(batches, "body", _SLICE):
            done = []
            for doc_id, packed, own in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "ranges"))):
                body = z.decompress(packed)
                kept, spans = kept_parts(body, own)
                done.append((doc_id, len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*done), kinds, names)], names)

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
