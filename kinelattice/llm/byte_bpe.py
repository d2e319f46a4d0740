"""Byte-level BPE over a global shuffle of distinct words (see ``distinct_words``).

Each match of the pattern is one pre-token; distinct pre-tokens are encoded once for the whole corpus and documents are
put together again by position. Decoding joins ids with the token-byte table on the map side: each task holds the table,
whose size the vocabulary fixes, so ids are never shuffled.

Edge cases: a null or empty text has no ids; ties and repeated rows are separate rows; special-token strings in a text are
ordinary text; doc_id may be null; a very long text is a chunk of its own and encoded whole; other columns are not read,
so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from kinelattice.llm.distinct_words import encode_words

_ranks: dict[str, dict[bytes, int]] = {}
_compiled: dict[str, regex.Pattern] = {}


def ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a .tiktoken file; read once in each process."""
    if path not in _ranks:
        with open(path, "rb") as f:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _ranks[path]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id."""
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, k in ranks(path).items():
        table[k] = token
    return table


def _splitter(pattern: str):
    def split(body: bytes) -> list[str]:
        if pattern not in _compiled:
            _compiled[pattern] = regex.compile(pattern)
        return _compiled[pattern].findall(body.decode())

    return split


def _encoder(path: str):
    def make():
        # each word is one pre-token already: a pattern that takes it whole
        encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        return lambda words: [np.array(encode(w.decode()), np.uint32).tobytes() for w in words]

    return make


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text as an array."""
    finisher = lambda: lambda doc_id, ids: [(doc_id, ids.astype(np.int32))]
    return encode_words(docs, _splitter(pattern), _encoder(path), finisher, "doc_id bigint, ids array<int>", ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded: the bytes of each row's ids. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([b"".join(map(table.__getitem__, ids or ())) for ids in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without keeping ids or bytes."""

    def finisher():
        table = token_bytes(path)

        def finish(doc_id: int | None, ids: np.ndarray) -> list[tuple]:
            decoded = b"".join(map(table.__getitem__, ids.tolist()))
            return [(doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())]

        return finish

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encode_words(docs, _splitter(pattern), _encoder(path), finisher, ddl, names, [pa.int64(), pa.int64(), pa.string(), pa.string()])
