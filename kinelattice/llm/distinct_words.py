"""Encoding words once for a whole corpus: a global shuffle of distinct words.

(1) Each task cuts its texts into words and keeps, for each block of documents, the distinct words and every
document's word numbers in order (its positions). (2) The distinct words of all blocks meet by hash in buckets, where
each distinct word is encoded once. (3) The ids go back to their blocks, and each document is put together again by
position.

A frequent word travels once per block of ``block_bytes``, however often it occurs, so it makes no hot key. Only words
and word numbers are shuffled, packed; texts are not. Buckets and blocks are dealt to as many tasks as the bytes of the
input ask for, one block to a task, so the largest task does not grow with the corpus; a task keeps the words of one
bucket at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.llm.textcols import in_chunks, tasks_for, texts
from kinelattice.session import cut

_ROW = pa.schema([("words", pa.bool_()), ("bucket", pa.int32()), ("block", pa.int64()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())])
#: Input bytes whose words share a bucket.
BUCKET_BYTES = 64 << 20
_DDL = "words boolean, bucket int, block bigint, seq int, doc_ids array<bigint>, a binary, b binary"


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed: small numbers cost little."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.asarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _pack_refs(x: np.ndarray) -> bytes:
    """Word numbers by frequency: a leading byte (the number under 128, else its high part), a low byte, a rare rest."""
    z = zstandard.ZstdCompressor(level=3)
    far = x >= 128
    high = (x[far] - 128) >> 8
    lead = x.astype(np.uint8)
    lead[far] = 128 + np.minimum(high, 127)
    parts = [z.compress(lead.tobytes()), z.compress((x[far] - 128).astype(np.uint8).tobytes()), _pack(high[high >= 127])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_refs(b: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        parts.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    d = zstandard.ZstdDecompressor()
    x = np.frombuffer(d.decompress(parts[0]), np.uint8).astype(np.int64)
    far = x >= 128
    high = x[far] - 128
    high[high == 127] = _unpack(parts[2])
    x[far] = 128 + (high << 8) + np.frombuffer(d.decompress(parts[1]), np.uint8)
    return x


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[k] .. start[k] + size[k] - 1 for each k in turn."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _block_rows(block: int, number: dict, chunks: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block: the words by bucket, then the documents in chunks. Words are numbered by frequency."""
    seen = np.zeros(len(number), np.int64)
    for _, _, refs in chunks:
        seen += np.bincount(refs, minlength=len(number))
    new = np.empty(len(number), np.int64)
    new[np.argsort(-seen, kind="stable")] = np.arange(len(number))
    words = [w.encode() if isinstance(w, str) else w for w in number]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.lexsort((new, bucket))
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            own = [words[k] for k in part]
            size = _pack(np.fromiter(map(len, own), np.int64, len(own)))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(own))
            a = len(size).to_bytes(4, "little") + size + body
            yield _rows([(True, int(bucket[part[0]]), block, -1, None, a, _pack(np.diff(new[part], prepend=0)))])
    for seq, (ids, sizes, refs) in enumerate(chunks):
        yield _rows([(False, None, block, seq, ids, _pack(sizes), _pack_refs(new[refs]))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _cutter(split: Callable[[bytes], list], buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        number: dict = {}
        chunks: list = []
        for part in in_chunks(batches, "body", 1 << 20):
            refs, sizes = [], []
            for body in part.column("body").to_pylist():
                words = split(body) if body else []
                refs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                sizes.append(len(words))
                held += len(body or b"")
            chunks.append((part.column("doc_id").to_pylist(), sizes, np.concatenate(refs)))
            if held >= block_bytes:
                yield from _block_rows(block, number, chunks, buckets)
                block, held, number, chunks = block + 1, 0, {}, []
        if chunks:
            yield from _block_rows(block, number, chunks, buckets)

    return run


def _word_encoder(encoder: Callable[[], Callable[[list[bytes]], list[bytes]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        known: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for bucket, block, a, nums in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "a", "b"))):
                if bucket != at:
                    at, known = bucket, {}
                n = int.from_bytes(a[:4], "little")
                ends = np.cumsum(_unpack(a[4 : 4 + n])).tolist()
                body = zstandard.ZstdDecompressor().decompress(a[4 + n :])
                words = [body[x:y] for x, y in zip([0, *ends[:-1]], ends)]
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 4096):
                    known.update(zip(new[k : k + 4096], encode(new[k : k + 4096])))
                out = [known[w] for w in words]
                size = _pack(np.fromiter(map(len, out), np.int64, len(out)) // 4)
                yield _rows([(True, None, block, -1, None, len(size).to_bytes(4, "little") + size + _pack(np.frombuffer(b"".join(out), np.uint32)), nums)])

    return run


def _reassemble(finisher: Callable[[], Callable[[int | None, np.ndarray], list[tuple]]], names: list[str], kinds: list[pa.DataType]):
    """Documents from rows sorted by (block, words first, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finish = finisher()
        at, flat, start, size = None, None, None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("words", "block", "doc_ids", "a", "b")]
            for k in range(batch.num_rows):  # large values, taken out one by one
                words, block, doc_ids, a, b = (c[k].as_py() for c in columns)
                if block != at:
                    at, flat, start, size = block, [], None, None
                if words:
                    n = int.from_bytes(a[:4], "little")
                    flat.append((np.cumsum(_unpack(b)), _unpack(a[4 : 4 + n]), _unpack(a[4 + n :])))
                    continue
                if start is None:
                    n_words = sum(len(x[0]) for x in flat)
                    start, size, base = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), 0
                    for nums, sizes, ids in flat:
                        size[nums] = sizes
                        start[nums] = base + np.cumsum(sizes) - sizes
                        base += len(ids)
                    flat = np.concatenate([x[2] for x in flat]) if flat else np.zeros(0, np.int64)
                refs, per_doc = _unpack_refs(b), _unpack(a)
                ids = flat[spread(start[refs], size[refs])].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(size[refs])])[np.cumsum(per_doc)] if len(per_doc) else []
                done, last = [], 0
                for doc_id, end in zip(doc_ids, ends):
                    done += finish(doc_id, ids[last:end])
                    last = end
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    return run


def encode_words(docs: DataFrame, split, encoder, finisher, ddl: str, names: list[str], kinds: list[pa.DataType], block_bytes: int = 48 << 20) -> DataFrame:
    """Rows made of every document's ids.

    ``split(body)`` gives the words of a text; ``encoder()`` makes a function from words to their ids as little-endian
    32-bit bytes; ``finisher()`` makes one from (doc_id, ids) to rows. Both are called once in each task.
    """
    buckets = tasks_for(docs, BUCKET_BYTES)
    rows = cut(texts(docs).mapInArrow(_cutter(split, buckets, block_bytes), _DDL), "words")
    task, nth = F.shiftright("block", 24), F.col("block").bitwiseAND(0xFFFFFF)  # what cut the block, and which of its blocks it is
    first = rows.filter(~F.col("words") & (F.col("seq") == 0)).agg(F.count("*").alias("blocks"), F.max(task).alias("task"), F.max(nth).alias("nth")).first()
    tasks, deep = (first["task"] or 0) + 1, (first["nth"] or 0) + 1
    n = min(tasks * deep, 2 * first["blocks"]) or 1  # blocks number their tasks' outputs, so nearly all have a task of their own
    encoded = rows.filter("words").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_word_encoder(encoder), _DDL)
    back = encoded.unionByName(rows.filter(~F.col("words"))).repartitionById(n, F.pmod(task + nth * tasks, F.lit(n)).cast("int"))
    return back.sortWithinPartitions("block", "seq").mapInArrow(_reassemble(finisher, names, kinds), ddl)
