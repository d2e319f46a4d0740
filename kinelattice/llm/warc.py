"""WARC archives as a Spark data source and sink, split within files.

**Reading.** A file's bytes are dealt out in ranges. A task looks for the gzip magic in its range, takes a candidate for
a record only if a member decodes there to a well-formed WARC header whose block has the stated length, and owns the
records that *start* inside its range: it reads past the range's end to finish the last one, and goes from a record's
end to the next one's start, so bytes inside a record are never taken for another. Every record has one owner, however
the ranges fall. Members that are no WARC records (other gzip data between records) are passed over.

**Writing.** One gzip member per record, several records to a file, files of at most ``FILE_BYTES``. Tasks write under
temporary names; the driver's commit gives the final ones, so a lost or repeated task leaves nothing behind.

**Deduplication.** Of records with equal payloads from ``least`` bytes on one is a response, the others revisits that
refer to it. Equal payloads meet by SHA-256 of the whole payload, with the greatest id taken inside each task first and
hot payloads joined back by broadcast, so a page that fills a third of the table reaches no single task.

Files are opened through ``pyarrow.fs`` (local or mounted folders, HDFS, S3); driver and executors must both see them.

Edge cases: a null page is the empty payload; a null URL has no target field, other URLs are written with control
characters and spaces as percent codes; a null id is less than any number; rows that repeat an id with one payload are
records of their own, one of them at most the response; other columns are not read, so their names never clash; an
empty table gives an archive folder without records; a record of any length is held by one task while it is read. A
range that starts inside a record which holds whole WARC members *uncompressed* may take those for records; payloads of
UTF-8 text can't hold the magic.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b16encode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kinelattice.llm.skew import join_groups
from kinelattice.session import cut, drop, importable

MAGIC = b"\x1f\x8b\x08"
#: A file is closed after the record that passes this size.
FILE_BYTES = 1 << 30
_READ = 1 << 20
_STEP = 1 << 16
_BATCH = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
_DATE = "2024-01-01T00:00:00Z"
SCHEMA = "path string, offset bigint, member_bytes bigint, headers map<string,string>, http map<string,string>, payload binary"
_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("member_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# records ------------------------------------------------------------------------------------------------------------


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _fields(lines: list[bytes]) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        out[name.strip().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a decoded member, or None where it is no record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return None
    fields = _fields(lines[1:])
    if fields is None or not fields.get("Content-Length", "").isdigit() or not {"WARC-Type", "WARC-Record-ID"} <= fields.keys():
        return None
    n = int(fields["Content-Length"])
    return (fields, rest[:n]) if rest[n:] == b"\r\n\r\n" else None


class _View:
    """Bytes of a file from a moving offset on, read in blocks."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.held = file, size, at, b""

    def more(self) -> bool:
        """Read another block; False at the end of the file."""
        start = self.at + len(self.held)
        if start >= self.size:
            return False
        self.file.seek(start)
        got = self.file.read(min(_READ, self.size - start))
        self.held += got
        return bool(got)

    def move(self, to: int) -> None:
        self.held = self.held[to - self.at :] if to - self.at < len(self.held) else b""
        self.at = to


def _find(view: _View, end: int) -> int | None:
    """The first magic from the view's start on that begins before ``end``."""
    while view.at < end:
        k = view.held.find(MAGIC)
        if k >= 0:
            return view.at + k if view.at + k < end else None
        view.move(view.at + max(len(view.held) - len(MAGIC) + 1, 0))
        if not view.more():
            return None
    return None


def _member(view: _View) -> tuple[bytes, int] | None:
    """The decoded member at the view's start and its length in bytes; None where none decodes whole and as a WARC text."""
    unpack, out, taken = zlib.decompressobj(31), bytearray(), 0
    while not unpack.eof:
        if taken == len(view.held) and not view.more():
            return None
        own = view.held[taken : taken + _STEP]
        try:
            out += unpack.decompress(own)
        except zlib.error:
            return None
        taken += len(own) - len(unpack.unused_data)
        if not out.startswith(b"WARC/"[: len(out)]):
            return None  # some other member, or none: not worth decoding further
    return bytes(out), taken


def scan(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, fields, block) of the records that start in [start, end)."""
    view = _View(file, size, start)
    while (at := _find(view, end)) is not None:
        view.move(at)
        got = _member(view)
        found = parse(got[0]) if got else None
        if found is None:
            view.move(at + 1)
            continue
        yield at, got[1], *found
        view.move(at + got[1])


# data source --------------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("split_bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.root)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else None
        if found is None:
            raise FileNotFoundError(f"no archives at {self.root!r}")
        own = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(".warc.gz"))
        out = [Range(p, k, min(k + self.split, n)) for p, n in own for k in range(0, n, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        files, _ = _open(self.root)
        rows, size = [], 0
        with files.open_input_file(part.path) as file:
            for at, n, fields, block in scan(file, file.size(), part.start, part.end):
                http: dict[str, str] | None = None
                if fields.get("Content-Type", "").startswith("application/http"):
                    head, gap, body = block.partition(b"\r\n\r\n")
                    if gap:
                        http, block = _fields(head.split(b"\r\n")[1:]), body
                rows.append((part.path, at, n, fields, http, block))
                size += len(block)
                if size > _BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, at, n, fields, http, block = zip(*rows)
    maps = ([None if x is None else list(x.items()) for x in own] for own in (fields, http))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((path, at, n, *maps, block), _ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (member binary) as files of whole members."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.root)
        names, out, size = [], None, 0
        for batch in iterator:
            for member in batch.column(0):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    files.create_dir(f"{root}/_temporary", recursive=True)
                    out, size = files.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), 0
                size += out.write(member.as_buffer())
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.root)
        files.create_dir(root, recursive=True)
        for name in (x for m in messages if m for x in m.names):
            files.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self._clean(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.root))

    def _clean(self, files: fs.FileSystem, root: str) -> None:
        """What failed or repeated tasks have left goes too."""
        if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Records of all ``.warc.gz`` files under ``path``: path, offset, member_bytes, headers, http, payload.

    Ranges have ``split_bytes``; by default what gives each core one range, from 1 MB to the session's largest input
    partition. ``http`` is NULL, and the payload the whole block, where the content is no HTTP message.
    """
    importable(spark)
    spark.dataSource.register(WarcDataSource)
    if split_bytes is None:
        files, root = _open(path)
        info = files.get_file_info(root)
        total = sum(x.size or 0 for x in files.get_file_info(fs.FileSelector(root, recursive=True))) if info.type == fs.FileType.Directory else info.size or 0
        largest = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        split_bytes = max(1 << 20, min(largest, -(-total // spark.sparkContext.defaultParallelism)))
    return spark.read.format("warc").option("split_bytes", str(split_bytes)).load(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> None:
    """Archive ``pages``: a response record for each, or a revisit where another row has the same payload of ``least`` bytes or more.

    The response among equal payloads is the row with the greatest id. A response's record id is made of its id and
    payload digest, which is unique where revisits refer to it; other ids end in a number of their own.
    """
    spark = pages.sparkSession
    importable(spark)
    spark.dataSource.register(WarcDataSource)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("body"))
    keyed = rows.select("*", F.sha2("body", 256).alias("digest"))
    own = keyed.filter(F.octet_length("body") >= least).groupBy("digest", "id").agg(F.count("*").alias("n"))
    groups = own.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("last"), F.sum("n").alias("copies")).filter("copies > 1")
    groups = cut(groups.select("digest", F.col("last.id").alias("keep"), F.col("last.n").alias("twins"), "copies"), "warc-groups")
    met = join_groups(keyed, groups, ["digest"], "copies", how="left")
    shared = F.col("copies").isNotNull()
    met = met.select("id", "url", "body", "digest", "keep", shared.alias("shared"), (shared & ~F.col("id").eqNullSafe(F.col("keep"))).alias("refers"))
    if not groups.filter("twins > 1").isEmpty():  # rows that repeat the greatest id with its payload: one of them is the response
        wins = F.col("shared") & ~F.col("refers")
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
        met = met.filter(~wins).unionByName(met.filter(wins).withColumn("refers", nth > 1))
    out = met.select("id", "url", "body", "keep", "shared", "refers", F.monotonically_increasing_id().alias("own"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, size = [], 0
            for row in batch.to_pylist():
                members.append(_page(**row))
                size += len(members[-1])
                if size > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])
                    members, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    out.mapInArrow(pack, "member binary").write.format("warc").mode("append").save(path)
    drop(groups)


def _name(id_: int | None) -> str:
    return "" if id_ is None else str(id_)


def _page(id: int | None, url: str | None, body: bytes, keep: int | None, shared: bool, refers: bool, own: int) -> bytes:
    sha1 = hashlib.sha1(body).digest()
    hexed = b16encode(sha1).decode().lower()
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:page:{_name(id)}:{hexed}{'' if shared and not refers else f':{own}'}>"),
        ("WARC-Date", _DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{b32encode(sha1).decode()}"))
    if refers:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{_name(keep)}:{hexed}>")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return record(fields, http_head(len(body)) + (b"" if refers else body))


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the records of :func:`write_warc`.

    A response is measured by its payload, and one that differs from its header's digest is an error; a revisit has the
    length and digest that its headers carry.
    """
    kind = F.element_at("headers", "WARC-Type")
    number = lambda name: F.element_at(F.split(F.element_at("headers", name), ":"), 3).try_cast("bigint")
    stated = base32_hex(F.substring_index(F.element_at("headers", "WARC-Payload-Digest"), ":", -1))
    found = F.sha1("payload")
    bad = F.raise_error(F.concat(F.lit("a payload differs from its digest: "), F.element_at("headers", "WARC-Record-ID")))
    return records.filter(kind.isin("response", "revisit")).select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(kind == "revisit", F.element_at("http", "Content-Length").cast("bigint")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when((kind == "revisit") | (found == stated), stated).otherwise(bad.cast("string")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", number("WARC-Refers-To")).alias("refers_to"),
    )


def base32_hex(text: Column) -> Column:
    """Lower-case hex of a base-32 text of whole groups (a SHA-1 digest has four), in built-in functions."""
    digits = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")
    groups = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(4)), lambda k: F.lpad(F.lower(F.conv(F.substring(digits, k, F.lit(4)), 32, 16)), 5, "0"))
    return F.array_join(groups, "")
