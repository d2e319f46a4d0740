"""A bounded membership bitmap, to thin rows before a join.

One bit per hashed id (a bigint, or a digest, of which the first eight bytes count), at most ``CAP_BITS`` bits (32 MB) however many ids there are: with more ids it lets more rows
through, never fewer, so a join after it decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.session import importable

CAP_BITS = 1 << 28
_BLOCK = 1 << 12


def _spot(ids: np.ndarray, mask: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(mask)).astype(np.int64)


def longs(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of 16-byte digests."""
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def may_contain(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _spot(ids, len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def build(ids: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a bigint or digest column; blocks are joined by OR in tasks, the driver receives each block once."""
    importable(ids.sparkSession)
    ids = ids.select(F.col(column).alias("id")).filter("id is not null")
    size = min(CAP_BITS, 1 << max(15, (16 * ids.count()).bit_length()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            own = b.column("id")
            at = np.unique(_spot(longs(own.to_pylist()) if pa.types.is_binary(own.type) else own.to_numpy(), size - 1))
            for part in np.split(at, np.flatnonzero(np.diff(at >> 15)) + 1):
                if len(part):
                    bits = np.zeros(_BLOCK * 8, np.uint8)
                    bits[part & 0x7FFF] = 1
                    own = have.setdefault(int(part[0] >> 15), np.zeros(_BLOCK, np.uint8))
                    own |= np.packbits(bits, bitorder="little")
        yield _rows(have)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for block, bits in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
                own = have.setdefault(block, np.zeros(_BLOCK, np.uint8))
                own |= np.frombuffer(bits, np.uint8)
        yield _rows(have)

    out = np.zeros(size // 8, np.uint8)
    for r in ids.mapInArrow(blocks, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").collect():  # CAP_BITS / 8 bytes at most
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["bits"], np.uint8)
    return out


def _rows(have: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], ["block", "bits"])
