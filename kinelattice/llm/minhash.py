"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct 5-word shingles. Documents with equal sets, by a 128-bit digest of the digests of all
shingles, are one class and only its least doc_id goes on. ``BANDS`` bands of ``ROWS`` full minima generate candidates (a pair at similarity 0.75 shares
no band with probability 5e-6); of each of ``HASHES`` minima ``BITS`` low bits are kept, packed in longs, and a bit count of the
difference estimates the similarity, corrected for chance collisions. Candidates within ``MARGIN`` of the threshold
are confirmed on the full sets of shingles, word by word and not by hashes.

Groups of any size stay spread. Each band value is aggregated to its least member, and every member is confirmed
against that hub alone; components of these links follow. Then only band values that still hold several components
are opened again, and just their pairs across components are tested, so that no link between different texts is lost
while a group of near copies never makes all its pairs.

Edge cases: texts without words (null, empty) have an empty set and are linked with nothing; texts of under five
words are one shingle; rows with a null doc_id are not linked and have a null component; rows that repeat a doc_id
are one node (ties between its texts: any of them stands for it); a very long text is one row of its chunk and is read
whole; other columns are not read, so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelattice.llm import bitmap
from kinelattice.llm.components import components
from kinelattice.llm.skew import join_groups
from kinelattice.llm.textcols import in_chunks, texts
from kinelattice.session import cut, drop

BANDS, ROWS = 32, 4
#: Hashes and bits of each minimum in the packed signature; its estimate at similarity 0.75 has a deviation of 0.02.
HASHES, BITS = 512, 4
#: Candidates are confirmed from four deviations below the threshold.
MARGIN = 0.08
#: Members of an open band that a task compares with all others of the band.
OPEN = 2048
#: A hub's members are confirmed by up to so many tasks, each with a copy of the hub.
HUB_SALTS = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_PER_LONG = 64 // BITS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    return x ^ (x >> np.uint64(33))


class _Digests(dict):
    """128-bit digests of words; short words are remembered, at most ``most`` of them."""

    def __init__(self, most: int = 1 << 18):
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = digest
        return digest


_digests = _Digests()


def _windows(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbol and length of every window of ``width`` symbols, and the number of each text's windows.

    A shorter text is one window, an empty one none.
    """
    n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    first = np.cumsum(size) - size
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.minimum(size, width), n), n


def shingles(bodies: list[bytes | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (2 x shingles) of all shingles of all texts in text order, and the number of each text's.

    They combine cryptographic digests of the words, so no structure of the texts makes different shingles collide.
    """
    words = [(b or b"").lower().split() for b in bodies]
    size = np.fromiter(map(len, words), np.int64, len(words))
    own = np.frombuffer(b"".join(map(_digests.__getitem__, chain.from_iterable(words))), np.uint64).reshape(-1, 2)
    at, many, n = _windows(size, width)
    out = np.empty((2, len(at)), np.uint64)
    for lane in (0, 1):
        digest, x = np.ascontiguousarray(own[:, lane]), many.astype(np.uint64)
        for k in range(width):
            inside = many > k
            part = digest[at + k] if inside.all() else np.where(inside, digest[np.where(inside, at + k, 0)], np.uint64(0))
            x = (x + part) * np.uint64(_BASE)
        out[lane] = mix(x)
    return out, n


def number_windows(symbols: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal exactly where windows of ``width`` symbols (from 0) are, and the number of each text's."""
    at, many, n = _windows(size, width)
    base, top = int(symbols.max(initial=-1)) + 2, 1
    code = np.zeros(len(at), np.int64)
    for k in range(width):
        if top * base > 1 << 62:  # no hash: the prefixes so far are numbered
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            top = len(code) + 1
        inside = many > k
        own = symbols[at + k] + 1 if inside.all() else np.where(inside, symbols[np.where(inside, at + k, 0)] + 1, 0)
        code, top = code * base + own, top * base
    return code, n


def numbered_shingles(bodies: list[bytes | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all shingles of all texts, equal exactly for equal shingles of these texts, and each text's number."""
    words = [(b or b"").lower().split() for b in bodies]
    size = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int64, int(size.sum()))
    return number_windows(symbols, size, width)


def minima(values: np.ndarray, n: np.ndarray, hashes: int, seed: int = 1) -> np.ndarray:
    """MinHash minima, texts x hashes, of consecutive runs of n[k] values; every n[k] > 0."""
    odd = np.random.default_rng(seed).integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = values if values.dtype == np.uint32 else (values >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum(n) - n
    buffer = np.empty_like(low)
    out = np.empty((len(n), hashes), np.uint32)
    for k in range(hashes):
        np.multiply(low, odd[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, start) if len(n) else 0
    return out


def bands(minimum: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per text and band of ``rows`` full minima; different bands never share a value on purpose."""
    x = minimum.astype(np.uint64).reshape(len(minimum), minimum.shape[1] // rows, rows)
    out = np.tile(np.arange(x.shape[1], dtype=np.uint64), (len(minimum), 1))
    for k in range(rows):
        out = mix(out * np.uint64(_BASE) + x[:, :, k])
    return out.view(np.int64)


def pack_bits(minimum: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima as bit planes: all minima's lowest bits in 64-bit words, then their second ones, ..."""
    shift = np.arange(64, dtype=np.uint64)
    planes = [((minimum >> np.uint32(p)) & np.uint32(1)).astype(np.uint64).reshape(len(minimum), minimum.shape[1] // 64, 64) << shift for p in range(bits)]
    return np.concatenate([np.bitwise_or.reduce(x, axis=2) for x in planes], axis=1).view(np.int64)


def estimate(a: Column | list[Column], b: Column | list[Column], longs: int, bits: int) -> Column:
    """Similarity from two packed signatures: the share of equal cells, corrected for chance collisions.

    The signatures are arrays, or lists of one column per word: on pairs of a join the latter take about a sixth of the time.
    """
    per = longs // bits

    def different(k: int) -> Column:
        return reduce(Column.bitwiseOR, (a[p * per + k].bitwiseXOR(b[p * per + k]) for p in range(bits)))

    equal = 1 - reduce(lambda p, q: p + q, (F.bit_count(different(k)) for k in range(per))) / F.lit(64.0 * per)
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def _words(side: str) -> list[str]:
    return [f"{side}{k}" for k in range(HASHES // _PER_LONG)]


def _unpacked(side: str) -> list[Column]:
    """The signature as one column per word."""
    return [F.col("packed")[k].alias(c) for k, c in enumerate(_words(side))]


def _alike(least: float) -> Column:
    """Whether the estimate of the signatures unpacked as sides p and q reaches ``least``."""
    p, q = ([F.col(c) for c in _words(side)] for side in "pq")
    return estimate(p, q, len(p), BITS) >= least


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, "body", 1 << 20):
            (values, more), n = shingles(part.column("body").to_pylist(), width)
            some = np.flatnonzero(n)
            low = minima(values, n[some], HASHES)
            key: list[bytes | None] = [None] * len(n)
            count = np.zeros(len(n), np.int64)
            ends = np.cumsum(n)
            for k in some.tolist():
                own, at = np.unique(values[ends[k] - n[k] : ends[k]], return_index=True)
                full = own.tobytes() + more[ends[k] - n[k] + at].tobytes()
                count[k], key[k] = len(own), hashlib.blake2b(full, digest_size=16).digest()
            each = lambda x: [x[j] if j >= 0 else None for j in where]
            where = np.full(len(n), -1)
            where[some] = np.arange(len(some))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count), pa.array(key, pa.binary()), pa.array(each(bands(low[:, : BANDS * ROWS], ROWS)), pa.list_(pa.int64())), pa.array(each(pack_bits(low, BITS)), pa.list_(pa.int64()))],
                ["doc_id", "n", "key", "bands", "packed"],
            )

    return run


def _compress(asked):
    """Texts whose doc_id may be asked for, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(bitmap.may_contain(asked.value, b.column("doc_id").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([z.compress(x or b"") for x in b.column("body").to_pylist()], pa.binary())], ["doc_id", "body"])

    return run


def _confirm(width: int, percent: int):
    """Rows sorted by (hub, salt, hub first): the members whose full set, by its words, is similar enough to their hub's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        at, lead = None, b""
        for part in in_chunks(batches, "body", 1 << 18):
            keys = list(zip(part.column("hub").to_pylist(), part.column("salt").to_pylist()))
            bodies = [z.decompress(b) for b in part.column("body").to_pylist()]
            numbers, n = numbered_shingles([lead if keys[0] == at else b"", *bodies], width)
            ends, a, b = np.cumsum(n), [], []
            own = np.unique(numbers[: n[0]])
            for k, (key, node) in enumerate(zip(keys, part.column("node").to_pylist())):
                have = np.unique(numbers[ends[k] : ends[k + 1]])
                if key != at:
                    at, own, lead = key, have, bodies[k]
                    if node == key[0]:
                        continue
                both = len(np.intersect1d(own, have, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(have) - both):
                    a.append(key[0])
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _shared_bands(many):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band = b.column("bands").flatten().to_numpy()
            hit = np.flatnonzero(bitmap.may_contain(many.value, band))
            of = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band[hit]), b.column("rep").take(of)], ["band", "rep"])

    return run


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b: distinct doc_ids, a the hub) whose full sets have the similarity; written once.

    A hub is repeated for every salt of its members, so a hub with many members is confirmed by many tasks.
    """
    members = pairs.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int").alias("salt"))
    hubs = members.select(F.col("hub").alias("node"), "hub", "salt").distinct()
    asked = cut(members.unionByName(hubs), "asked")
    nodes = docs.sparkSession.sparkContext.broadcast(bitmap.build(asked, "node"))
    bodies = texts(docs).filter(F.col("doc_id").isNotNull()).mapInArrow(_compress(nodes), "doc_id bigint, body binary")
    rows = bodies.join(asked, bodies["doc_id"] == asked["node"]).select("hub", "salt", "node", "body")
    placed = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"))
    links = cut(placed.mapInArrow(_confirm(width, percent), "a bigint, b bigint"), "links")
    drop(asked)
    return links


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(texts(docs).mapInArrow(_sign(width), "doc_id bigint, n bigint, key binary, bands array<bigint>, packed array<bigint>"), "signatures")
    classes = signed.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key")
    reps = cut(classes.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.count("*").alias("copies")), "classes")
    hubs = reps.select(F.explode("bands").alias("band"), "rep").groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n"))
    hubs = cut(hubs.filter("n > 1").select("band", "hub"), "hubs")
    many = docs.sparkSession.sparkContext.broadcast(bitmap.build(hubs, "band"))
    at_band = reps.mapInArrow(_shared_bands(many), "band bigint, rep bigint")
    shared = cut(at_band.join(hubs, "band"), "bands")  # members of band values that several classes have
    drop(hubs)
    least = percent / 100 - MARGIN
    first = shared.filter("rep <> hub").groupBy("rep").agg(F.min("hub").alias("hub"))  # each member and its least hub
    first = cut(first, "members")
    asked = first.groupBy("hub").agg(F.count("*").alias("members"))
    leads = cut(asked.join(reps.select(F.col("rep").alias("hub"), *_unpacked("q")), "hub"), "leads")
    met = join_groups(first, leads, ["hub"], "members")  # a hub with many members comes to them, not they to it
    tried = cut(met.join(reps.select("rep", *_unpacked("p")), "rep").filter(_alike(least)).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "tried")
    drop(first)
    drop(leads)
    links = confirm(docs, tried, width, percent)
    drop(tried)
    found = components(links)
    drop(links)

    named = shared.join(found, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low <> high")
    mixed = mixed.select("band", F.ceil(F.col("members") / OPEN).cast("int").alias("salts"))
    open_ = named.join(mixed, "band").join(reps, "rep")
    x, y = (open_.select(*(F.col(c).alias(f"{c}_{s}") for c in ("rep", "band", "component", "bands")), "salts", *_unpacked(w)) for s, w in ("xp", "yq"))
    # of a large band each task gets a part of one side and all of the other
    x = x.withColumn("salt_x", F.pmod(F.xxhash64("rep_x"), F.col("salts")).cast("int")).drop("salts")
    y = y.withColumn("salt_y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    across = (F.col("band_x") == F.col("band_y")) & (F.col("salt_x") == F.col("salt_y")) & (F.col("component_x") < F.col("component_y"))
    across &= _alike(least)
    across &= F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("band_x")  # each pair at one of its bands
    rest = x.join(y, across).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    rest = cut(rest, "across")
    if not rest.isEmpty():
        more = confirm(docs, rest, width, percent)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        drop(more)
    drop(rest)
    drop(shared)

    of_key = reps.select("key", "rep", "copies").join(found, F.col("rep") == F.col("node"), "left").select("key", "copies", F.coalesce("component", "rep").alias("component"))
    of_key = cut(of_key, "components")
    own_key = signed.select("doc_id", "n", "key")
    known = join_groups(own_key.filter("key is not null"), of_key, ["key"], "copies", how="left")  # a text that many documents have is broadcast
    rows = known.select("doc_id", "n", "component").unionByName(own_key.filter("key is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("component")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    verdict = near_dup(docs)
    kept = verdict.filter("kept").select(F.col("doc_id").alias("_kl_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kl_id")), "left_semi")
