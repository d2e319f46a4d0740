"""Array archives (.npz) as a Spark data source and sink.

Every array starts with persons, cameras and frames; its ``data_description`` names the positions of each axis. Reading
gives the packed form: one row per person, camera, frame and label, the last axis in ``v`` and its names in ``axis``. The
driver only lists files and deals each one out in parts of ``split_bytes``; a task reads the headers of its archive, keeps
the blocks (array, person, camera, frames) that the filters leave, and takes its share of them. Filters on the parts of
the path reach the planner, those on ``array_name``, ``person``, ``camera`` and ``frame`` the blocks: in an uncompressed
archive a task seeks to its blocks and reads nothing else; a compressed member is decoded up to the last block that is
wanted. Descriptions may be JSON text or a pickled dict; pickles pass a reader that admits plain containers and arrays
only. :func:`read_axes` gives the axes of all arrays from headers alone.
"""

from __future__ import annotations

import io
import json
import os
import pickle
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from kinelattice.session import importable

SCHEMA = "path string, dataset string, session string, sequence string, component string, algorithm string, array_name string, person string, camera string, frame int, frame_idx int, label string, v array<double>, conf double, axis array<string>"
_ADMITTED = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}
#: Names under which a last axis ends in a confidence (fixed values).
CONFIDENCE = ("conf", "confidence", "confidence_score")


class _Plain(pickle.Unpickler):
    """Admits the names that arrays of plain values need, and nothing else."""

    def find_class(self, module: str, name: str):
        if (module, name) not in _ADMITTED:
            raise pickle.UnpicklingError(f"{module}.{name} is not admitted")
        return super().find_class(module, name)


def _header(raw) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of an array file; ``raw`` stands at its first value afterwards."""
    version = np.lib.format.read_magic(raw)
    return np.lib.format.read_array_header_1_0(raw) if version == (1, 0) else np.lib.format.read_array_header_2_0(raw)


def read_array(path: str, name: str) -> np.ndarray:
    """One array of an archive; KeyError for an unknown name."""
    with zipfile.ZipFile(path) as z:
        if f"{name}.npy" not in z.namelist():
            raise KeyError(f"{name} is not in {path}")
        raw = io.BytesIO(z.read(f"{name}.npy"))
    shape, _, dtype = _header(raw)
    if dtype.hasobject:
        return _Plain(raw).load()
    raw.seek(0)
    return np.lib.format.read_array(raw, allow_pickle=False).reshape(shape)


class Member:
    """An array inside an archive, read in runs of frames.

    A stored member is sought by its offset, so only what is asked for is read; a deflated one is decoded in order, and
    runs that come in ascending order are decoded once. ``taken`` counts the bytes of values that were read.
    """

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.info, self.raw, self.taken = archive.getinfo(f"{name}.npy"), archive.open(f"{name}.npy"), 0
        self.shape, self.fortran, self.dtype = _header(self.raw)
        self.first = self.raw.tell()
        self.stored = self.info.compress_type == zipfile.ZIP_STORED
        self.whole: np.ndarray | None = None

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop`` in the order of the file."""
        self.raw.seek(self.first + start * self.dtype.itemsize)
        got = self.raw.read((stop - start) * self.dtype.itemsize)
        self.taken += len(got)
        return np.frombuffer(got, self.dtype)

    def frames(self, person: int, camera: int, low: int, high: int) -> np.ndarray:
        """Values of frames ``low`` to ``high`` of one person and camera."""
        if self.dtype.hasobject:
            raise ValueError("an array of objects has no frames")
        if self.fortran:  # frames do not stand together
            if self.whole is None:
                self.raw.seek(0)
                self.whole = np.lib.format.read_array(self.raw, allow_pickle=False)
                self.taken += self.whole.nbytes
            return self.whole[person, camera, low:high]
        rest = self.shape[3:]
        step = int(np.prod(rest, dtype=np.int64)) * self.dtype.itemsize
        start = self.first + ((person * self.shape[1] + camera) * self.shape[2] + low) * step
        self.raw.seek(start)  # within a deflated member: decodes and drops what lies between
        got = self.raw.read((high - low) * step)
        self.taken += len(got)
        return np.frombuffer(got, self.dtype).reshape(high - low, *rest)


def array_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [n[:-4] for n in z.namelist() if n.endswith(".npy")]


def description(path: str) -> dict[str, dict]:
    """The axes of each array, from the archive or a JSON file beside it."""
    side = f"{path}.json"
    if os.path.exists(side):
        with open(side) as f:
            return json.load(f)
    got = read_array(path, "data_description").item()
    return json.loads(got) if isinstance(got, str) else got


def parse_path(path: str) -> dict[str, str | None]:
    """dataset, session, sequence, component, algorithm from .../<dataset>__<session>[__<sequence>]/<component>/<algorithm>.npz."""
    folder, component, name = path.split("/")[-3:] if path.count("/") >= 2 else ("", "", path)
    parts = folder.split("__", 2)
    return {"dataset": parts[0], "session": parts[1] if len(parts) > 1 else None, "sequence": parts[2] if len(parts) > 2 else None, "component": component, "algorithm": name.removesuffix(".npz")}


@dataclass
class ArchivePartition(InputPartition):
    path: str
    part: int = 0
    parts: int = 1


_PATH = ("dataset", "session", "sequence", "component", "algorithm")
_BLOCK_FRAMES = 4096


class _Wanted:
    """What filters leave: values by column, and bounds of the frame. Filters that it doesn't know stay with Spark."""

    def __init__(self):
        self.values: dict[str, set] = {}
        self.low, self.high = 0, 1 << 62

    def take(self, f: Filter) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, (EqualTo, In)) and name in (*_PATH, "array_name", "person", "camera", "frame"):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[name] = self.values[name] & own if name in self.values else own
            return True
        if name == "frame" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            return True
        if name == "frame" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        return False

    def has(self, name: str, value) -> bool:
        return name not in self.values or value in self.values[name]

    def frame(self, value: int) -> bool:
        return self.low <= value <= self.high and self.has("frame", value)


def _files(root: str) -> Iterator[str]:
    if os.path.isfile(root):
        yield root
    for folder, _, names in sorted(os.walk(root)):
        yield from (os.path.join(folder, n) for n in sorted(names) if n.endswith(".npz"))


def _described(path: str) -> dict[str, dict] | None:
    """The descriptions of an archive's arrays; None where there are none that can be read."""
    try:
        known = description(path)
    except (KeyError, OSError, ValueError, zipfile.BadZipFile, pickle.UnpicklingError):
        return None
    return {k: v for k, v in known.items() if isinstance(v, dict)} if isinstance(known, dict) else None


def _names(axes: dict, k: int) -> list[str] | None:
    """Names on an axis; None where it has none."""
    own = axes.get(f"axis{k}")
    return None if own is None or not len(own) else [own] if isinstance(own, str) else list(map(str, own))


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options.get("path", "").removeprefix("file://"), int(options.get("split_bytes", 64 << 20))
        self.wanted = _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from (f for f in filters if not self.wanted.take(f))

    def _paths(self) -> list[str]:
        files = list(_files(self.root))
        if not files:
            raise FileNotFoundError(f"no .npz archives under {self.root!r}")
        parts = ((p, parse_path(p)) for p in files)
        return [p for p, own in parts if all(self.wanted.has(c, own[c]) for c in _PATH)]


class NpzReader(_ArchiveReader):
    def partitions(self) -> list[ArchivePartition]:
        out = []
        for path in self._paths():
            n = max(1, -(-os.path.getsize(path) // self.split))
            out += [ArchivePartition(path, k, n) for k in range(n)]
        return out

    def _blocks(self, archive: zipfile.ZipFile, known: dict[str, dict]) -> list[tuple]:
        """(array, person, camera, low, high, bytes) that the filters leave, in the order of the file."""
        out = []
        for name in (n[:-4] for n in archive.namelist() if n.endswith(".npy")):
            if name not in known or not self.wanted.has("array_name", name):
                continue
            with archive.open(f"{name}.npy") as raw:
                shape, _, dtype = _header(raw)
            if len(shape) < 3 or dtype.hasobject:
                continue
            step = int(np.prod(shape[3:], dtype=np.int64)) * dtype.itemsize
            persons, cameras, frames = (_names(known[name], k) or ["none"] for k in range(3))
            good = np.flatnonzero([self.wanted.frame(int(f)) for f in frames])
            runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []
            for i, person in enumerate(persons):
                for j, camera in enumerate(cameras):
                    if self.wanted.has("person", person) and self.wanted.has("camera", camera):
                        out += [(name, i, j, a, min(a + _BLOCK_FRAMES, int(r[-1]) + 1), step * min(_BLOCK_FRAMES, int(r[-1]) + 1 - a)) for r in runs for a in range(int(r[0]), int(r[-1]) + 1, _BLOCK_FRAMES)]
        return out

    def read(self, partition: ArchivePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None or (known := _described(partition.path)) is None:
            return  # nothing was asked for, or an archive that holds no results; read_axes lists those
        with zipfile.ZipFile(partition.path) as archive:
            blocks = self._blocks(archive, known)
            total = sum(b[-1] for b in blocks)
            done, held, member = 0, None, None
            for name, i, j, low, high, size in blocks:
                owner = (done + size // 2) * partition.parts // max(total, 1)
                done += size
                if owner == partition.part:
                    if held != name:
                        held, member = name, Member(archive, name)
                    yield self._rows(partition.path, name, known[name], member.frames(i, j, low, high), i, j, low)

    def _rows(self, path: str, array: str, axes: dict, block: np.ndarray, i: int, j: int, low: int) -> pa.RecordBatch:
        persons, cameras, frames = (_names(axes, k) or ["none"] for k in range(3))
        labels = _names(axes, 3) if block.ndim == 3 else None
        shown = _names(axes, block.ndim + 1) if block.ndim > 1 else None
        split = shown is not None and not isinstance(axes[f"axis{block.ndim + 1}"], str) and shown[-1] in CONFIDENCE
        shown = (shown[:-1] if split else shown) if shown is not None else None
        values = np.asarray(block, float).reshape(len(block), len(labels) if labels else 1, -1)
        n, k = values.shape[:2]
        rows = values.reshape(n * k, -1)
        conf = rows[:, -1] if split else np.full(n * k, np.nan)
        v = rows[:, :-1] if split else rows
        same = {c: pa.array([x] * (n * k), pa.string()) for c, x in {"path": path, **parse_path(path), "array_name": array, "person": persons[i], "camera": cameras[j]}.items()}
        own = {
            "frame": pa.array(np.repeat(np.array([int(x) for x in frames[low : low + n]], np.int32), k)), "frame_idx": pa.array(np.repeat(np.arange(low, low + n, dtype=np.int32), k)),
            "label": pa.array(list(labels) * n if labels else [None] * n, pa.string()),
            "v": pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel(), pa.float64(), from_pandas=True)), "conf": pa.array(conf, from_pandas=True),
            "axis": pa.array([shown or None] * (n * k), pa.list_(pa.string())),
        }
        columns = same | own
        order = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([columns[c] for c in order], order)


AXES = "path string, dataset string, session string, sequence string, component string, algorithm string, array_name string, shape array<bigint>, axis0 array<string>, axis1 array<string>, axis2 array<string>, axis3 array<string>, axis4 array<string>, kind string, bytes bigint, crc bigint, problem string"


class AxesReader(_ArchiveReader):
    """Shapes and axis names of all arrays: headers and descriptions only, no values."""

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(p) for p in self._paths()]

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        base = tuple(parse_path(partition.path).values())
        known = _described(partition.path)
        if known is None:
            yield (partition.path, *base, None, None, *[None] * 8, "no readable description")
            return
        with zipfile.ZipFile(partition.path) as archive:
            for name in (n[:-4] for n in archive.namelist() if n.endswith(".npy") and n != "data_description.npy"):
                if not self.wanted.has("array_name", name):
                    continue
                with archive.open(f"{name}.npy") as raw:
                    shape, _, dtype = _header(raw)
                held = archive.getinfo(f"{name}.npy")
                axes = [_names(known[name], k) for k in range(5)] if name in known else [None] * 5
                off = [k for k, own in enumerate(axes) if own is not None and k < len(shape) and len(own) != shape[k]]
                problem = "no description" if name not in known else f"axes {off} differ from the shape" if off else None
                yield (partition.path, *base, name, list(shape), *axes, dtype.str, held.file_size, held.CRC, problem)


class AxesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_axes"

    def schema(self) -> str:
        return AXES

    def reader(self, schema) -> AxesReader:
        return AxesReader(self.options)


class NpzDataSource(DataSource):
    """``spark.read.format("npz").load(path)``; the path must be visible to driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, **options: str) -> DataFrame:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def read_npz(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The packed rows of all archives under ``path``; large archives are read by several tasks."""
    return _load(spark, NpzDataSource, path, split_bytes=str(split_bytes))


def read_axes(spark: SparkSession, path: str) -> DataFrame:
    """One row per array: path, its parts, array_name, shape, axis0 to axis4 (names, NULL where an axis has none), kind, bytes, crc, problem.

    ``kind`` is the type of the values, ``bytes`` and ``crc`` length and checksum of the array's file as the archive lists them.
    ``problem`` tells of an archive without a readable description, an array that it doesn't describe, or axes that differ
    from the shape.
    """
    return _load(spark, AxesDataSource, path)


# sink ---------------------------------------------------------------------------------------------------------------

_CELLS = "file string, array_name string, kind int, person string, camera string, frame int, label string, cell array<double>, persons array<string>, cameras array<string>, frames array<int>, labels array<string>, width int, shown array<string>, grid boolean"
_FILL = 1 << 18


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class _MemberOut:
    """A dense array written cell by cell in ascending order; cells that no row has are NaN. Of rows for one cell the last wins."""

    def __init__(self, archive: zipfile.ZipFile, head: dict):
        self.axes = {"person": pa.array(head["persons"]), "camera": pa.array(head["cameras"]), "frame": pa.array(head["frames"], pa.int32())}
        if head["labels"]:
            self.axes["label"] = pa.array(head["labels"])
        self.shape = [len(a) for a in self.axes.values()]
        self.cells, self.width, self.type = int(np.prod(self.shape, dtype=np.int64)), head["width"], np.dtype(np.float32 if head["grid"] else np.float64)
        self.out = archive.open(f"{head['array_name']}.npy", "w", force_zip64=True)
        whole = tuple(self.shape) if head["grid"] else (*self.shape, self.width)
        np.lib.format.write_array_header_2_0(self.out, {"descr": self.type.str, "fortran_order": False, "shape": whole})
        self.next, self.held = 0, None  # the cell to be written next; one cell and its values, until the next row is known
        names = [[str(x) for x in a.to_pylist()] if c != "frame" else [f"{x:09d}" for x in a.to_pylist()] for c, a in self.axes.items()]
        shown = [] if head["grid"] else [head["shown"] or [f"v{k}" for k in range(self.width)]]
        self.description = {f"axis{k}": own for k, own in enumerate([*names, *shown])}

    def _put(self, at: np.ndarray, values: np.ndarray) -> None:
        """Cells in ascending order, each once, from ``next`` on."""
        while len(at):
            end = min(self.next + _FILL, int(at[-1]) + 1)
            n = int(np.searchsorted(at, end))
            block = np.full((end - self.next, self.width), np.nan, self.type)
            block[at[:n] - self.next] = values[:n]
            self.out.write(block.tobytes())
            self.next, at, values = end, at[n:], values[n:]

    def add(self, rows: pa.RecordBatch) -> None:
        at = np.zeros(rows.num_rows, np.int64)
        for name, axis in self.axes.items():
            at = at * len(axis) + np.asarray(pa.compute.index_in(rows.column(name), axis))
        values = np.asarray(rows.column("cell").flatten().fill_null(np.nan)).reshape(-1, self.width)
        if self.held is not None:
            at, values = np.append(self.held[0], at), np.vstack([self.held[1], values])
        last = np.append(at[1:] != at[:-1], True)
        at, values = at[last], values[last]
        self._put(at[:-1], values[:-1])
        self.held = at[-1:], values[-1:]

    def close(self) -> None:
        if self.held is not None:
            self._put(*self.held)
        while self.next < self.cells:
            n = min(_FILL, self.cells - self.next)
            self.out.write(np.full((n, self.width), np.nan, self.type).tobytes())
            self.next += n
        self.out.close()


class NpzWriter(DataSourceArrowWriter):
    """Sorted rows, each array's axes before its cells, streamed into archives under a temporary name until the commit."""

    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = os.path.join(self.root, "_temporary", uuid.uuid4().hex)
        done = Written(folder, [])
        archive = member = None
        known: dict[str, dict] = {}

        def finish(whole: bool) -> None:
            nonlocal archive, member
            if member is not None:
                member.close()
                member = None
            if whole and archive is not None:
                raw = io.BytesIO()
                np.save(raw, np.array(json.dumps(known)))
                archive.writestr("data_description.npy", raw.getvalue())
                archive.close()
                known.clear()

        for batch in iterator:
            kinds = np.asarray(batch.column("kind"))
            heads = np.flatnonzero(kinds == 0).tolist()
            for a, b in zip([0, *heads], [*heads, batch.num_rows]):  # what comes before the first head belongs to the array before
                rows = batch.slice(a, b - a)
                if not rows.num_rows:
                    continue
                if kinds[a] == 0:
                    head = rows.slice(0, 1).to_pylist()[0]
                    fresh = not done.files or done.files[-1] != head["file"]
                    finish(fresh)
                    if fresh:
                        done.files.append(head["file"])
                        path = os.path.join(folder, head["file"])
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        archive = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True)
                    member = _MemberOut(archive, head)
                    known[head["array_name"]] = member.description
                    rows = rows.slice(1)
                if rows.num_rows:
                    member.add(rows)
        finish(True)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for file in m.files:
                os.makedirs(os.path.dirname(os.path.join(self.root, file)), exist_ok=True)
                os.replace(os.path.join(m.folder, file), os.path.join(self.root, file))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        shutil.rmtree(os.path.join(self.root, "_temporary"), ignore_errors=True)


def _save(cells: DataFrame, root: str) -> DataFrame:
    """Write (file, array_name, person, camera, frame, label, cell, shown, grid); returns (path, arrays).

    An array's axes are one aggregate, sent ahead of its cells in one sorted stream, so a task holds the axes and a block
    of cells, however large the grid is. The files appear when all of them are whole.
    """
    spark = cells.sparkSession
    importable(spark)
    spark.dataSource.register(NpzDataSource)
    some = lambda c: F.coalesce(F.col(c), F.lit("none"))
    cells = cells.withColumns({"person": some("person"), "camera": some("camera")})
    axis = lambda c, n: F.array_sort(F.collect_set(c)).alias(n)
    heads = cells.groupBy("file", "array_name").agg(
        axis("person", "persons"), axis("camera", "cameras"), axis("frame", "frames"), axis("label", "labels"), F.max(F.size("cell")).alias("width"), F.first("shown", ignorenulls=True).alias("shown"), F.first("grid").alias("grid")
    )
    names = [x.split(" ")[0] for x in _CELLS.split(", ")]
    kinds = dict(x.split(" ") for x in _CELLS.split(", "))
    rows = [df.select(*(F.col(n) if n in df.columns else F.lit(kind if n == "kind" else None).cast(kinds[n]).alias(n) for n in names)) for kind, df in ((0, heads), (1, cells.drop("shown", "grid")))]
    both = rows[0].unionByName(rows[1])
    order = ["file", "array_name", "kind", "person", "camera", "frame", "label"]
    both.repartition("file").sortWithinPartitions(*order).write.format("npz").mode("append").save(root)
    return heads.groupBy("file").agg(F.count("*").cast("int").alias("arrays")).select(F.concat(F.lit(root.rstrip("/") + "/"), "file").alias("path"), "arrays")


def _folder() -> Column:
    return F.concat_ws("__", "dataset", "session", "sequence")


def write_npz(values: DataFrame, root: str) -> DataFrame:
    """Metric values to archives <root>/<dataset>__<session>[__<sequence>]/<component>/<algorithm>__<metric_type>.npz.

    ``values`` has the long schema (metric_name ... frame, label, value). A file holds a dense grid [person, camera, frame,
    label] per metric, NaN where there is no value, axes sorted; of equal keys the greatest value wins. Returns the files
    written, (path, arrays). The root must be visible to all executors.
    """
    file = F.concat(F.concat_ws("/", _folder(), "component", F.concat_ws("__", "algorithm", "metric_type")), F.lit(".npz"))
    cell = F.array(F.col("value").cast("double"))
    own = values.groupBy(file.alias("file"), F.col("metric_name").alias("array_name"), "person", "camera", F.col("frame").cast("int").alias("frame"), F.col("label").cast("string").alias("label")).agg(F.max(cell).alias("cell"))
    return _save(own.withColumns({"label": F.coalesce("label", F.lit("none")), "shown": F.lit(None).cast("array<string>"), "grid": F.lit(True)}), root)


def write_features(arrays: DataFrame, root: str) -> DataFrame:
    """Packed arrays (the columns of ``read_npz``) to archives <root>/<dataset>__<session>[__<sequence>]/<component>/<algorithm>.npz.

    A file holds dense grids [person, camera, frame, label, coordinate], the confidence last where an array has one, NaN
    where there is no value; rows without a label give [person, camera, frame, coordinate]. Reading gives the same rows
    again. Returns the files written, (path, arrays). The root must be visible to all executors.
    """
    file = F.concat(F.concat_ws("/", _folder(), "component", "algorithm"), F.lit(".npz"))
    rows = arrays.select(file.alias("file"), "array_name", "person", "camera", "frame", "label", "v", "conf", "axis")
    sure = rows.groupBy("file", "array_name").agg((F.count("conf") > 0).alias("sure"))
    rows = rows.join(sure, ["file", "array_name"])
    cell = F.when(F.col("sure"), F.concat("v", F.array(F.col("conf").cast("double")))).otherwise(F.col("v"))
    names = F.coalesce("axis", F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: F.concat(F.lit("v"), k.cast("string"))))
    shown = F.when(F.col("sure"), F.concat(names, F.array(F.lit(CONFIDENCE[-1])))).otherwise(names)
    return _save(rows.select("file", "array_name", "person", "camera", "frame", "label", cell.alias("cell"), shown.alias("shown"), F.lit(False).alias("grid")), root)


def long_values(arrays: DataFrame, axis: DataFrame | None = None, joined: bool = False) -> DataFrame:
    """Read metric archives in the long schema; the algorithm's ``__`` suffix is the metric type.

    The label is the array's own or, in grids [person, camera, frame, label], the last axis' name at pos; ``axis``
    (pos, label) goes before the names in the archive. With ``joined``, all of the folder's name after the dataset is the
    sequence, and there is no session level.
    """
    parts = F.split("algorithm", "__", 2)
    out = arrays.withColumns({"metric_type": F.try_element_at(parts, F.lit(2)), "algorithm": F.element_at(parts, 1), "metric_name": F.col("array_name")})
    head = ["metric_name", "dataset", "session", "sequence", "component", "algorithm", "metric_type", "person", "camera"]
    if joined:
        out = out.withColumn("sequence", F.concat_ws("__", "session", "sequence"))
        head.remove("session")
    out = out.select(*head, "label", "axis", "frame", "frame_idx", F.posexplode("v").alias("pos", "value"))
    names = [F.col("label"), F.get("axis", "pos")]
    if axis is not None:
        out = out.join(F.broadcast(axis.select("pos", F.col("label").alias("given"))), "pos", "left")
        names.insert(1, F.col("given"))
    return out.select(*head, F.coalesce(*names).alias("label"), "frame", "frame_idx", "pos", "value")
