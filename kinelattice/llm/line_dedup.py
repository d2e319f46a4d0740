"""Fuzzy line dedup by MinHash over character shingles.

Every line with a word is known by a 128-bit digest of its bytes (equal lines share it) and has ``BANDS`` x ``ROWS``
minima over its character shingles. Band values travel packed to hash buckets; lines that share one are candidates: all
pairs of up to ``SMALL`` lines, in larger runs each line with the run's first line and with its neighbours. Candidates
are verified by exact Jaccard similarity, on the shingles themselves, and a distributed union-find joins them. Larger
runs that still hold several components are then opened again and all their pairs across components are verified, block
by block in many tasks, so every pair of lines that shares a band is either verified or in one component already. Of each
component the first line of the corpus, by (doc_id, line number), stays.

At similarity 0.8 a pair shares no band with probability 2e-3. Nothing depends on how the input is partitioned: every
distinct line of a chunk meets all its runs. A band value that more than ``SMALL`` lines of a chunk share is a large run
by that alone; its lines go straight to the opened runs, spread over tasks, and only one of them to the bucket, so no
bucket holds a hot band.

Edge cases: null and empty texts have no lines; lines without a word are never dropped; lines shorter than a shingle
are one shingle; repeated lines of one text count; rows with a null doc_id keep all lines; repeated rows share their
doc_id's lines (the first copy's line stays in each of them); ties can't occur, as lines are in order by doc_id and place; very long texts are chunks of their own and read whole;
other columns are not read, so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.llm import bitmap
from kinelattice.llm.components import components
from kinelattice.llm.minhash import bands, minima, number_windows
from kinelattice.llm.skew import join_groups
from kinelattice.llm.textcols import ASCII_SPACE, in_chunks, tasks_for, texts
from kinelattice.session import cut, drop

BANDS, ROWS, WIDTH = 12, 4, 7
SMALL = 8
#: Lines and bytes of a block; two blocks of a large run are compared in one go.
BLOCK, BLOCK_BYTES = 512, 1 << 18
#: A hub's members are verified by up to so many tasks, each with a copy of the hub.
HUB_SALTS = 64
#: Input bytes that share the buckets of one task.
TASK_BYTES = 64 << 20
_C = np.uint32(0x7F4A7C15)


def split_lines(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Text index, line number, bytes and digest of every line with a word."""
    doc, number, lines = [], [], []
    for k, body in enumerate(bodies):
        for j, line in enumerate(body.split(b"\n") if body else ()):
            if line.strip(ASCII_SPACE):
                doc.append(k)
                number.append(j)
                lines.append(line)
    return np.array(doc, np.int64), np.array(number, np.int64), lines, [hashlib.blake2b(x, digest_size=16).digest() for x in lines]


def _characters(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, and each line's number of them."""
    chars = [x.decode("utf-8", "replace") for x in lines]
    return np.frombuffer("".join(chars).encode("utf-32-le", "replace"), np.uint32), np.fromiter(map(len, chars), np.int64, len(chars))


def _rolled(code: np.ndarray, size: np.ndarray, by: int, bits: int, sized: bool) -> np.ndarray:
    """All shingles of all lines (none empty) as numbers to the base ``by``, modulo 2 ** bits, in the type of ``code``.

    With ``sized``, those of lines shorter than a shingle start with their size.
    """
    end = np.cumsum(size)
    h = np.zeros_like(code)
    for k in range(WIDTH):  # the shingle that starts at each character; one past the line is cut off below
        h *= code.dtype.type(by)
        h[: len(code) - k] += code[k:]
    keep = np.ones(len(code), bool)
    for k in range(1, WIDTH):
        keep[(end - k)[size >= WIDTH]] = False
        keep[(end - k)[(size > k) & (size < WIDTH)]] = False
    short = np.flatnonzero(size < WIDTH)
    first = end - size
    for k in short.tolist():
        word = int(size[k]) if sized else 0
        for c in code[first[k] : end[k]].tolist():
            word = (word * by + c) & (1 << bits) - 1
        h[first[k]] = word
    return h[keep]


def line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all character shingles of all lines, and the number of each line's (at least 1)."""
    code, size = _characters(lines)
    n = np.maximum(size - WIDTH + 1, 1)
    h = _rolled(code, size, int(_C), 32, True)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(by)
    return h, n


def numbered_line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all character shingles, equal exactly for equal shingles of these lines, and the number of each line's."""
    code, size = _characters(lines)
    there = np.zeros(int(code.max(initial=0)) + 1, bool)
    there[code] = True
    kinds = np.cumsum(there)  # symbols from 1 on: as digits, they tell short shingles from long ones
    base = int(kinds[-1]) + 1
    if base**WIDTH > 1 << 62 or not size.all():
        return number_windows((kinds - 1)[code], size, WIDTH)
    return _rolled(kinds[code], size, base, 62, False), np.maximum(size - WIDTH + 1, 1)


def _digests(digests: list[bytes]) -> np.ndarray:
    """Digests as two columns of longs."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _binary(rows: np.ndarray) -> pa.Array:
    """Digests from two columns of longs."""
    raw = np.ascontiguousarray(rows, np.int64).tobytes()
    return pa.array([raw[k : k + 16] for k in range(0, len(raw), 16)], pa.binary())


def _runs(band: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct entries by band and id, where each stood, and the start and size of every run of equal bands."""
    order = np.lexsort((ids[:, 1], ids[:, 0], band))
    band, ids = band[order], ids[order]
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1]).any(1)
    band, ids, order = band[new], ids[new], order[new]
    start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.zeros(0, np.int64)
    return band, ids, order, start, np.diff(np.append(start, len(band)))


def _pairs(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among entries in runs of ``size``: all pairs of small runs, neighbours and the first line in large ones."""
    of = np.repeat(size, size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    a, b = [], []
    for gap in range(1, SMALL):
        hit = np.flatnonzero((at >= gap) & ((of <= SMALL) | (gap == 1)))
        a.append(ids[hit - gap])
        b.append(ids[hit])
    hit = np.flatnonzero((at > 1) & (of > SMALL))
    return np.concatenate([*a, ids[hit - at[hit]]]), np.concatenate([*b, ids[hit]])


_SENT = "bucket int, hot boolean, run bigint, bands binary, ids binary"


def _packed(bucket: int | None, hot: bool, run: int | None, bands_: np.ndarray | None, ids: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([bucket], pa.int32()), pa.array([hot]), pa.array([run], pa.int64()), pa.array([None if bands_ is None else bands_.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(ids).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, [c.split(" ")[0] for c in _SENT.split(", ")])


def _send(buckets: int):
    """Per chunk: for every bucket the packed (band, line) entries, and for every hot band its run and packed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            band, ids, _, start, count = _runs(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            bucket = ((band.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            run = (band & 0xFFFFFFFF) | bucket << 32
            large = np.repeat(count, count) > SMALL
            for k, n in zip(start[count > SMALL].tolist(), count[count > SMALL].tolist()):
                yield _packed(None, True, int(run[k]), None, ids[k : k + n])
            lead = np.zeros(len(band), bool)
            lead[start] = True
            for hot, some in ((False, ~large), (True, large & lead)):
                at = np.flatnonzero(some)
                at = at[np.argsort(bucket[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1):
                    if len(part):
                        yield _packed(int(bucket[part[0]]), hot, None, band[part].astype(np.uint32), ids[part])

        for part in in_chunks(batches, "body", 1 << 19):
            _, _, lines, ids = split_lines(part.column("body").to_pylist())
            new = []
            for k, x in enumerate(ids):
                if x not in seen:
                    seen.add(x)
                    new.append(k)
            if len(seen) > 1 << 18:
                seen.clear()
            if not new:
                continue
            values, n = line_shingles([lines[k] for k in new])
            own = bands(minima(values, n, BANDS * ROWS), ROWS)
            held.append((own.ravel(), np.repeat(_digests([ids[k] for k in new]), BANDS, axis=0)))
            size += own.size
            if size > 1 << 20:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


_MET = "run bigint, a binary, b binary"


def _met(run: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if run is None else pa.array(run), _binary(a), pa.nulls(len(a), pa.binary()) if b is None else _binary(b)], ["run", "a", "b"])


def _candidates(ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return _met(None, *_pairs(ids, size))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: candidates (a, b) of one bucket after the other, and the members (run, a) of its large runs."""

    def done(bucket: int, parts: list) -> Iterator[pa.RecordBatch]:
        band, ids, hot = (np.concatenate([p[k] for p in parts]) for k in range(3))
        hot_bands = np.unique(band[hot])
        band, ids, _, start, size = _runs(band, ids)
        yield _candidates(ids, size)
        large = np.repeat((size > SMALL) | np.isin(band[start], hot_bands), size)
        yield _met(band[large].astype(np.int64) | bucket << 32, ids[large], None)

    at, held = None, []
    for batch in batches:
        for bucket, hot, x, y in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hot", "bands", "ids"))):
            if bucket != at:
                if held:
                    yield from done(at, held)
                at, held = bucket, []
            band = np.frombuffer(x, np.uint32)
            held.append((band, np.frombuffer(y, np.int64).reshape(-1, 2), np.full(len(band), hot)))
    if held:
        yield from done(at, held)


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates and members of the runs that were hot in a chunk already."""
    for batch in batches:
        for run, y in zip(batch.column("run").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(y, np.int64).reshape(-1, 2)
            yield _candidates(ids, np.array([len(ids)]))
            yield _met(np.full(len(ids), run), ids, None)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in in_chunks(batches, "body"):
        doc, number, _, ids = split_lines(part.column("body").to_pylist())
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(ids, pa.binary())], ["doc_id", "line", "id"])


def _verify(percent: int):
    """Rows sorted by (hub, salt, hub first): the members whose lines have the similarity to their hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, b""
        for part in in_chunks(batches, "line", 1 << 19):
            keys = list(zip(part.column("hub").to_pylist(), part.column("salt").to_pylist()))
            lines = part.column("line").to_pylist()
            numbers, n = _distinct(*numbered_line_shingles([lead if keys[0] == at else lines[0], *lines]))
            ends, a, b = np.cumsum(n).tolist(), [], []
            own, full = numbers[: ends[0]], ends[0]
            own = np.append(own, -1)  # never found
            for k, (key, node) in enumerate(zip(keys, part.column("node").to_pylist())):
                have, size = numbers[ends[k] : ends[k + 1]], ends[k + 1] - ends[k]
                if key != at:
                    at, own, full, lead = key, np.append(have, -1), size, lines[k]
                    if node == key[0]:
                        continue
                if 100 * min(full, size) < percent * max(full, size):  # too different in number
                    continue
                both = int(np.count_nonzero(own[own[:-1].searchsorted(have)] == have))
                if 100 * both >= percent * (full + size - both):
                    a.append(key[0])
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _distinct(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct numbers in order, and how many they are; every n[k] > 0."""
    start = np.cumsum(n) - n
    for low, size in zip(start.tolist(), n.tolist()):
        numbers[low : low + size].sort()
    new = np.ones(len(numbers), bool)
    new[1:] = numbers[1:] != numbers[:-1]
    new[start] = True
    return numbers[new], np.add.reduceat(new, start, dtype=np.int64)


def _compare(cell: pa.Table, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Links between the components of two blocks (x, y; the same one twice on the diagonal), from all pairs across."""
    x, y, block = (cell.column(c).to_numpy() for c in ("x", "y", "block"))
    values, n = numbered_line_shingles(cell.column("line").to_pylist())
    kinds, code = np.unique(values, return_inverse=True)
    mine = np.unique(np.repeat(np.arange(len(n)), n) * len(kinds) + code)
    count = np.bincount(mine // len(kinds), minlength=len(n))
    order = np.lexsort((count, block != x))  # block x, then block y, each by the number of distinct shingles
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    mine = np.sort(rank[mine // len(kinds)] * len(kinds) + mine % len(kinds))
    code, count = mine % len(kinds), count[order]
    ids = [cell.column("id")[k].as_py() for k in order.tolist()]
    label = np.unique(np.array(cell.column("component").to_pylist(), object), return_inverse=True)[1][order]
    end = np.cumsum(count)
    start, has, diagonal = end - count, np.zeros(len(kinds), np.int32), x[0] == y[0]
    n_x = int(np.count_nonzero(block == x))
    first, a, b = 0 if diagonal else n_x, [], []
    for k in range(n_x):
        low = k + 1 if diagonal else first + int(np.searchsorted(100 * count[first:], percent * count[k]))
        high = first + int(np.searchsorted(percent * count[first:], 100 * count[k], "right"))
        if low >= high or (label[low:high] == label[k]).all():
            continue
        own = code[start[k] : end[k]]
        has[own] = 1
        both = np.add.reduceat(has[code[start[low] : end[high - 1]]], start[low:high] - start[low])
        has[own] = 0
        hit = low + np.flatnonzero((100 * both >= percent * (count[k] + count[low:high] - both)) & (label[low:high] != label[k]))
        joined, at = np.unique(label[hit], return_index=True)
        a += [ids[k]] * len(joined)
        b += [ids[j] for j in hit[at].tolist()]
        if len(joined):
            label[np.isin(label, joined)] = label[k]
    return a, b


def _cells(percent: int):
    """Rows sorted by (run, x, y): links from each cell's pairs across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            a, b = _compare(pa.Table.from_batches(held), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("run", "x", "y")])
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edge, edge[1:]):
                if (key := tuple(keys[low].tolist())) != at:
                    if held:
                        yield done()
                    at, held = key, []
                held.append(batch.slice(low, high - low))
        if held:
            yield done()

    return run


def _across(runs: DataFrame, found: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that one run (run, id) holds, from all its pairs across components.

    The lines of a run outside its largest component meet all others. They fill blocks 0 .. less - 1, the largest
    component fills the blocks after them; a line goes to every cell (x, y), x <= y and x < less, of its block.
    """
    named = runs.join(found, F.col("id") == F.col("node"), "left").select("run", "id", F.coalesce("component", "id").alias("component"))
    named = cut(named.join(lines.select("id", F.length("line").alias("bytes")), "id"), "line-named")
    parts = named.groupBy("run", "component").agg(F.struct(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), "component").alias("part"))
    whole = parts.groupBy("run").agg(F.max("part").alias("top"), F.sum("part.n").alias("n"), F.sum("part.bytes").alias("bytes")).filter("n > top.n")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES))
    whole = whole.select("run", "n", F.col("top.component").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("less"), blocks(F.col("top.n"), F.col("top.bytes")).alias("more"))
    spot = F.xxhash64("id")
    block = F.when(F.col("component") == F.col("top"), F.col("less") + F.pmod(spot, "more")).otherwise(F.pmod(spot, "less"))
    placed = join_groups(named, cut(whole, "line-blocks"), ["run"], "n").withColumn("block", block)
    cell = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    as_y = F.transform(F.sequence(F.lit(0), F.least("block", F.col("less") - 1)), lambda x: cell(x, F.col("block")))
    last = F.col("less") + F.col("more") - 1
    as_x = F.when(F.col("block") < F.col("less"), F.transform(F.sequence(F.col("block") + 1, last), lambda y: cell(F.col("block"), y)))
    cells = placed.select("run", "block", "id", "component", F.explode(F.concat(as_y, F.coalesce(as_x, F.array().cast("array<struct<x:bigint,y:bigint>>")))).alias("cell"))
    rows = cells.join(lines, "id").select("run", "cell.x", "cell.y", "block", "id", "component", "line")
    return rows.repartition("run", "x", "y").sortWithinPartitions("run", "x", "y").mapInArrow(_cells(percent), "a binary, b binary")


def _texts_of(body: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line) of the lines in ``nodes`` (id); each distinct line leaves a task once."""
    asked = body.sparkSession.sparkContext.broadcast(bitmap.build(nodes, "id"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, "body"):
            _, _, lines, ids = split_lines(part.column("body").to_pylist())
            hit = {ids[k]: k for k in np.flatnonzero(bitmap.may_contain(asked.value, bitmap.longs(ids))).tolist()} if ids else {}
            yield pa.RecordBatch.from_arrays([pa.array(list(hit), pa.binary()), pa.array([lines[k] for k in hit.values()], pa.binary())], ["id", "line"])

    once = body.mapInArrow(wanted, "id binary, line binary").groupBy("id").agg(F.min("line").alias("line"))
    return once.join(nodes, "id", "left_semi")


def similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(node, component): digests of lines that are not the least of their component of similar lines."""
    n = tasks_for(docs, TASK_BYTES)
    body = texts(docs).filter("doc_id is not null")
    sent = cut(body.select("doc_id", "body").mapInArrow(_send(4 * n), _SENT), "line-bands")
    buckets = sent.filter("bucket is not null").repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket")
    met = buckets.mapInArrow(_meet, _MET).unionByName(sent.filter("bucket is null").mapInArrow(_hot, _MET))
    met = cut(met, "line-runs")
    drop(sent)
    pairs = cut(met.filter("run is null and a <> b").select("a", "b").distinct(), "line-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = cut(_texts_of(body, nodes), "line-texts")
    members = pairs.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int").alias("salt"))
    asked = members.unionByName(members.select(F.col("hub").alias("node"), "hub", "salt").distinct())
    rows = asked.join(found.withColumnRenamed("id", "node"), "node").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"))
    links = cut(rows.mapInArrow(_verify(percent), "a binary, b binary"), "line-links")
    drop(pairs)
    linked = components(links)
    drop(links)
    runs = met.filter("run is not null").select("run", F.col("a").alias("id")).distinct()
    more = cut(_across(runs, linked, found, percent), "line-across")
    drop(met)
    if more.isEmpty():
        return linked
    return components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per doc_id with lines: doc_id, n_lines (with a word), dropped (array of line numbers, from 0).

    A frequent line is aggregated before it meets its component, and lines are judged by (doc_id, line), so no task gets
    all copies of a line.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    lines = cut(texts(docs).filter("doc_id is not null").mapInArrow(_occurrences, "doc_id bigint, line int, id binary").distinct(), "lines")
    found = similar_lines(docs, percent)
    each = lines.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    named = each.join(found, F.col("id") == F.col("node"), "left").select("first", F.coalesce("component", "id").alias("component"))
    first = named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.line", F.lit(True).alias("stays"))
    judged = lines.select("doc_id", "line").join(first, ["doc_id", "line"], "left")
    return judged.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("stays").isNull(), F.col("line")))).alias("dropped"))


def dedup_texts(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of the text; all other columns stay."""
    gone = verdict.select(F.col("doc_id").alias("_kl_id"), F.col("dropped").alias("_kl_dropped")).filter(F.size("dropped") > 0)
    joined = docs.join(gone, docs[id_col] == F.col("_kl_id"), "left")
    left = F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains("_kl_dropped", k))
    text = F.when(F.col("_kl_id").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("_kl_text", text).select(*(F.col("_kl_text").alias(c) if c == text_col else docs[c] for c in docs.columns))
