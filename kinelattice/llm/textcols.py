"""Arrow helpers for operators that read whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelattice.session import importable

#: White space of the word definitions: space and \t to \r, ASCII only. ``bytes.split()`` splits at exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): only the two columns an operator reads, the text as UTF-8 bytes; other columns never clash."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column`` each (a longer value comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        block = (np.cumsum(size) - size) // limit
        start = 0
        for end in [*(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def tasks_for(docs: DataFrame, per_task: int, text_col: str = "text") -> int:
    """Tasks that share out the texts' bytes, and at least the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from columns by name, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
