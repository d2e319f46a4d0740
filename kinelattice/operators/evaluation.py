"""The evaluation run: from a root of prediction archives and a truth archive to frame values and summaries.

1. *Work items*: one row per array that a configured metric reads, from the archives' headers alone. It holds the
   positions at which the array and its truth agree, so packed rows whose axis orders differ by file are reconciled by one
   join with this small table.
2. *Rows*: the archives of the items are decoded once into a table of packed rows, within the videos' frames.
3. *Metrics*: each one plans frame values and a summary over that table and is run on its own; one that fails is noted
   and leaves the others.

Frames without truth stay, without a value. A confidence at the end of the last axis is no coordinate. Arrays of
booleans have no coordinates: their last axis is reconciled itself. An axis that both sides lack needs no agreement;
where no name is common, the item has a problem and no metric reads it. Counts leave out elements that are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelattice.functions.vec import distance
from kinelattice.operators import metrics, temporal
from kinelattice.operators.align import ARRAYS, allowed_arrays
from kinelattice.operators.results import write_metric_summaries
from kinelattice.session import cut
from kinelattice.sources.config import Scope, error_scope
from kinelattice.sources.npz import CONFIDENCE, read_axes, read_npz, write_npz

FRAMES = ("metric_name", "dataset", "session", "sequence", "component", "algorithm", "metric_type", "person", "camera", "frame", "label", "value")
SUMMARY = ("dataset", "metric_type", "metric", "component", "algorithm", "person", "camera", "value")
_SERIES = ["dataset", "session", "sequence", "component", "algorithm", "metric_type", "person", "camera"]


@dataclass(frozen=True)
class Video:
    """A part of a recording; a negative length has no end."""

    session: str
    sequence: str | None = None
    start: int = 0
    length: int = -1


@dataclass(frozen=True)
class MetricType:
    name: str
    metrics: tuple[str, ...]
    components: tuple[str, ...]
    needs_truth: bool = False


@dataclass(frozen=True)
class Task:
    """What to evaluate for one dataset. ``synonyms`` renames the truth's names, by axis (``axis0`` to ``axis4``)."""

    dataset: str
    videos: tuple[Video, ...]
    metric_types: tuple[MetricType, ...]
    algorithms: Mapping[str, tuple[str, ...]]
    synonyms: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    bones: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    diameters: Mapping[str, float] = field(default_factory=dict)
    arrays: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: ARRAYS)


@dataclass
class EvaluationRun:
    """``frames`` and ``summary`` hold what the metrics that ran gave; ``items`` the arrays that were found, ``axes`` all there are."""

    task: Task
    items: DataFrame
    frames: DataFrame
    summary: DataFrame
    axes: DataFrame
    unknown: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def problems(self) -> DataFrame:
        """Arrays of a metric that it can't read, one row each."""
        return self.items.filter("problem is not null")

    @property
    def unread(self) -> DataFrame:
        """Archives without a readable description, and arrays whose axes differ from their shape."""
        return self.axes.filter("problem is not null and problem <> 'no description'").select("path", "array_name", "problem")

    def save(self, output_dir: str, single: bool = True) -> list[str]:
        """Frame values as archives, summaries as one CSV per metric type (a folder of them unless ``single``)."""
        written = [r["path"] for r in write_npz(self.frames, output_dir).collect()]
        return written + write_metric_summaries(self.summary.drop("dataset"), output_dir, self.task.dataset, single)


# work items ---------------------------------------------------------------------------------------------------------


def _renamed(names: Column, synonyms: Mapping[str, str]) -> Column:
    if not synonyms:
        return names
    known = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    return F.transform(names, lambda x: F.coalesce(F.try_element_at(known, x), x))


def _one(name: Column, synonyms: Mapping[str, str]) -> Column:
    return F.element_at(_renamed(F.array(name), synonyms), 1)


def _coordinates(axis: Column) -> Column:
    """An axis without a confidence at its end."""
    return F.when(F.element_at(axis, -1).isin(*CONFIDENCE), F.slice(axis, 1, F.size(axis) - 1)).otherwise(axis)


def _places(common: Column, axis: Column) -> Column:
    return F.transform(common, lambda x: F.array_position(axis, x).cast("int"))


def _truth_dimension(array_name: Column) -> Column:
    return F.when(F.lower(array_name).contains("3d"), "3d").otherwise("2d")


def work_items(pred_axes: DataFrame, truth_axes: DataFrame | None, task: Task) -> DataFrame:
    """One row per array and metric type: path, array_name, metric_type, start, stop, truth_key, labels, pred_at, truth_at, problem.

    ``labels`` are the common names of the label axis in the prediction's order, ``pred_at`` and ``truth_at`` the places
    (from 1) of the common names of the last axis on either side. Without truth they are those of the prediction.
    """
    spark = pred_axes.sparkSession
    wanted = [(m.name, c, a, m.needs_truth) for m in task.metric_types for c in m.components for a in task.algorithms.get(c, ())]
    wanted = spark.createDataFrame(wanted, "metric_type string, component string, algorithm string, needs_truth boolean")
    videos = spark.createDataFrame([(v.session, v.sequence or None, v.start, v.start + v.length if v.length >= 0 else None) for v in task.videos], "session string, own string, start long, stop long")
    arrays = allowed_arrays(pred_axes.filter((F.col("dataset") == task.dataset) & F.col("problem").isNull()), dict(task.arrays))
    arrays = arrays.join(F.broadcast(wanted), ["component", "algorithm"])  # a row of the configuration each
    arrays = arrays.join(F.broadcast(videos), (arrays["session"] == videos["session"]) & arrays["sequence"].eqNullSafe(videos["own"])).drop(videos["session"]).drop("own")
    labelled = F.size("shape") == 5
    arrays = arrays.withColumns({
        "truth_key": F.concat_ws("__", "session", F.when(F.col("sequence") != "", F.col("sequence")), _truth_dimension(F.col("array_name"))),
        "own_labels": F.when(labelled, F.col("axis3")), "own_last": _coordinates(F.when(labelled, F.col("axis4")).otherwise(F.col("axis3"))),
        "n_last": F.size(F.when(labelled, F.col("axis4")).otherwise(F.col("axis3"))),
    })
    if truth_axes is None:
        truth_axes = spark.createDataFrame([], "array_name string, shape array<bigint>, axis3 array<string>, axis4 array<string>, problem string")
    labelled = F.size("shape") == 5
    three, four = _renamed(F.col("axis3"), task.synonyms.get("axis3", {})), _renamed(F.col("axis4"), task.synonyms.get("axis4", {}))
    truth = truth_axes.filter(F.col("problem").isNull()).select(F.col("array_name").alias("truth_key"), F.when(labelled, three).alias("truth_labels"), _coordinates(F.when(labelled, four).otherwise(three)).alias("truth_last"), F.lit(True).alias("there"))
    met = arrays.join(truth, "truth_key", "left")
    both = F.col("needs_truth") & F.col("there").isNotNull()
    shared = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.filter(a, lambda x: F.array_contains(b, x)))
    met = met.withColumns({
        "labels": F.when(both, shared("own_labels", "truth_labels")).otherwise(F.col("own_labels")),
        "last": F.when(both, shared("own_last", "truth_last")).otherwise(F.col("own_last")),
    })
    apart = lambda own, other, common: (F.col(own).isNotNull() != F.col(other).isNotNull()) | (F.col(own).isNotNull() & (F.size(common) == 0))
    problem = F.when(F.col("needs_truth") & F.col("there").isNull(), "no ground truth").when(both & (apart("own_labels", "truth_labels", "labels") | apart("own_last", "truth_last", "last")), "no common labels")
    return met.select(
        "path", "dataset", "session", "sequence", "component", "algorithm", "array_name", "metric_type", "needs_truth", "start", "stop", "truth_key", "labels",
        _places(F.col("last"), F.col("own_last")).alias("pred_at"), F.when(both, _places(F.col("last"), F.col("truth_last"))).alias("truth_at"), "n_last", problem.alias("problem"),
    )


# metrics ------------------------------------------------------------------------------------------------------------


def _pick(v: Column, at: Column) -> Column:
    return F.transform(at, lambda k: F.element_at(v, k))


def rows_of(pred: DataFrame, items: DataFrame, metric_type: str) -> DataFrame:
    """Packed rows of a metric type's arrays, in the videos' frames, with common labels and coordinates only."""
    own = items.filter((F.col("metric_type") == metric_type) & F.col("problem").isNull()).select("path", "array_name", "metric_type", "start", "stop", "truth_key", "labels", "pred_at", "truth_at", "n_last")
    met = pred.join(own, ["path", "array_name"])
    inside = (F.col("frame") >= F.col("start")) & (F.col("stop").isNull() | (F.col("frame") < F.col("stop")))
    met = met.filter(inside & (F.col("labels").isNull() | F.array_contains("labels", F.col("label"))))
    return met.withColumn("v", _pick(F.col("v"), F.col("pred_at")))


def truth_rows(truth: DataFrame, task: Task) -> DataFrame:
    """truth_key, person, camera, frame, label, truth: the truth under the dataset's synonyms."""
    names = task.synonyms.get
    return truth.select(F.col("array_name").alias("truth_key"), *(_one(F.col(c), names(a, {})).alias(c) for c, a in (("person", "axis0"), ("camera", "axis1"))), "frame", F.coalesce(_one(F.col("label"), names("axis3", {})), F.lit("")).alias("label"), F.col("v").alias("truth"))


def with_truth(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds truth: the truth's values at the common places, NULL where a frame has none."""
    keys = ["truth_key", "person", "camera", "frame"]
    met = rows.withColumn("_label", F.coalesce("label", F.lit(""))).join(truth.withColumnRenamed("label", "_label"), [*keys, "_label"], "left")
    return met.withColumn("truth", _pick(F.col("truth"), F.col("truth_at"))).drop("_label")


def _long(df: DataFrame, metric: str, label: str, value: Column) -> DataFrame:
    return df.select(F.lit(metric).alias("metric_name"), *_SERIES[:6], "person", "camera", "frame", F.col(label).alias("label"), value.cast("double").alias("value")).select(*FRAMES)


def _summed(df: DataFrame, metric_type: str) -> DataFrame:
    return df.select("dataset", F.lit(metric_type).alias("metric_type"), "metric", "component", "algorithm", "person", "camera", F.col("value").cast("double").alias("value"))


def joint_errors(rows: DataFrame, truth: DataFrame) -> tuple[DataFrame, None]:
    """Joint error by frame and label."""
    return _long(with_truth(rows, truth), "jpe", "label", distance(F.col("v"), F.col("truth"))), None


def _in_space(rows: DataFrame, items: DataFrame, metric_type: str, exact: bool) -> DataFrame:
    """Rows of 3-D arrays, which must have three coordinates and a confidence."""
    is_3d = F.col("array_name") == "3d" if exact else F.col("array_name").contains("3d")
    bad = items.filter((F.col("metric_type") == metric_type) & is_3d & (F.col("n_last") != 4)).select("path", "n_last").limit(3).collect()
    if bad:
        raise ValueError(f"3-D keypoints need three coordinates and a confidence: {[(r['path'], r['n_last']) for r in bad]}")
    return rows.filter(is_3d)


def bone_lengths(rows: DataFrame, items: DataFrame, metric_type: str, bones: Mapping[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Bone lengths by frame; their mean and deviation by person."""
    table = rows.sparkSession.createDataFrame([(b, *ends) for b, ends in bones.items()], "bone string, start string, end string")
    points = _in_space(rows, items, metric_type, exact=True)
    lengths = metrics.bone_lengths(points, [*_SERIES, "frame"], table)
    summary = metrics.bone_summary(lengths.filter("bone_length is not null"), ["dataset", "component", "algorithm", "person"])
    return _long(lengths, "bone_length", "bone", F.col("bone_length")), _summed(summary, metric_type)


def jumps(rows: DataFrame, items: DataFrame, metric_type: str, diameters: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """Whether each joint jumped into a frame; the number of jumps by person and camera. Series end with their sequence."""
    limits = rows.sparkSession.createDataFrame(list(diameters.items()), "label string, diameter double")
    points = _in_space(rows, items, metric_type, exact=False).withColumns({c: F.element_at("v", k + 1) for k, c in enumerate("xyz")})
    flags = temporal.jump_flags(points, [*_SERIES, "array_name", "label"], ["x", "y", "z"], limits, "label", "diameter").filter("jump is not null")
    counts = metrics.jump_count(flags, ["dataset", "component", "algorithm", "person", "camera"]).withColumnsRenamed({"jump_count": "value"}).withColumn("metric", F.lit("jump_count"))
    return _long(flags, "jump_detection", "label", F.col("jump").cast("int")), _summed(counts, metric_type)


def agreement_counts(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, tn, fp, fn of elements that are set (not 0) against the truth, by person and camera."""
    met = with_truth(rows, truth).filter("truth is not null")
    n = lambda said, true: F.sum(F.size(F.filter(F.arrays_zip("v", "truth"), lambda x: ((x["v"] != 0) == F.lit(said)) & ((x["truth"] != 0) == F.lit(true)))))
    return met.groupBy("dataset", "component", "algorithm", "person", "camera").agg(n(True, True).alias("tp"), n(False, False).alias("tn"), n(True, False).alias("fp"), n(False, True).alias("fn"))


def registry(pred: DataFrame, truth: DataFrame, items: DataFrame, task: Task) -> dict[str, Callable[[], tuple[DataFrame | None, DataFrame | None]]]:
    """Every metric that there is, as ``<metric type>/<metric>``."""
    rows = partial(rows_of, pred, items)
    cloud, points, flags = "point_cloud_metrics", "keypoint_metrics", "categorical_metrics"
    scores = {"f1_score" if n == "f1" else n: m for n, m in metrics.CATEGORICAL.items()}
    counts = cache(lambda: cut(agreement_counts(rows(flags), truth), "evaluation-counts"))  # once for all scores
    return {
        f"{cloud}/jpe": lambda: joint_errors(rows(cloud), truth),
        f"{points}/bone_length": lambda: bone_lengths(rows(points), items, points, task.bones),
        f"{points}/jump_detection": lambda: jumps(rows(points), items, points, task.diameters),
        **{f"{flags}/{n}": partial(lambda m, n: (None, _summed(counts().withColumns({"value": m(), "metric": F.lit(n)}), flags)), m, n) for n, m in scores.items()},
    }


# runs ---------------------------------------------------------------------------------------------------------------


def axes_of(packed: DataFrame) -> DataFrame:
    """An axis table for packed rows that come from no archive: labels in order of their names, the shape's rank only."""
    labels = F.array_sort(F.collect_set("label"))
    last = F.first("axis", ignorenulls=True)
    last = F.when(F.count("conf") > 0, F.concat(last, F.array(F.lit(CONFIDENCE[-1])))).otherwise(last)
    base = ["path", "dataset", "session", "sequence", "component", "algorithm", "array_name"]
    own = packed.groupBy(*base).agg(labels.alias("labels"), last.alias("last"))
    flat = F.size("labels") == 0
    rank = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    return own.select(*base, F.when(flat, rank(4)).otherwise(rank(5)).alias("shape"), F.when(flat, F.col("last")).otherwise(F.col("labels")).alias("axis3"), F.when(~flat, F.col("last")).alias("axis4"), F.lit(None).cast("string").alias("problem"))


def _union(spark: SparkSession, frames: Iterable[DataFrame], schema: str) -> DataFrame:
    own = list(frames)
    return reduce(DataFrame.unionByName, own) if own else spark.createDataFrame([], schema)


def evaluate(pred: DataFrame, truth: DataFrame | None, pred_axes: DataFrame, truth_axes: DataFrame | None, task: Task) -> EvaluationRun:
    """Run every configured metric over packed rows (the columns of ``read_npz``) and axis tables (those of ``read_axes``)."""
    spark = pred.sparkSession
    items = cut(work_items(pred_axes, truth_axes, task), "evaluation-items")
    if truth is None:
        truth = spark.createDataFrame([], "array_name string, person string, camera string, frame int, label string, v array<double>")
    known = registry(pred, truth_rows(truth, task), items, task)
    run = EvaluationRun(task, items, None, None, pred_axes)
    frames, summaries = [], []
    for name in (f"{m.name}/{n}" for m in task.metric_types for n in m.metrics):
        if name not in known:
            run.unknown.append(name)
            continue
        noted: list[str] = []
        with error_scope(Scope.DETECTOR, noted, name):
            values, summary = known[name]()
            done = (cut(values, "evaluation-frames") if values is not None else None, cut(summary, "evaluation-summary") if summary is not None else None)
            frames += [done[0]] if done[0] is not None else []
            summaries += [done[1]] if done[1] is not None else []
        if noted:
            run.failed[name] = noted[0]
    run.frames = _union(spark, frames, "metric_name string, dataset string, session string, sequence string, component string, algorithm string, metric_type string, person string, camera string, frame int, label string, value double")
    run.summary = _union(spark, summaries, "dataset string, metric_type string, metric string, component string, algorithm string, person string, camera string, value double")
    return run


def evaluate_roots(spark: SparkSession, pred_root: str, truth_path: str | None, task: Task) -> EvaluationRun:
    """Evaluate the archives under ``pred_root`` against a truth archive whose arrays are named session, sequence, dimension.

    Headers give the work items; then only arrays that an item names are decoded, once, into a table that all metrics read.
    """
    pred_axes = cut(read_axes(spark, pred_root).filter(F.col("dataset") == task.dataset), "evaluation-axes")
    truth_axes = cut(read_axes(spark, truth_path), "evaluation-truth-axes") if truth_path else None
    found = work_items(pred_axes, truth_axes, task)
    some = sorted({a for own in task.arrays.values() for a in own})
    packed = read_npz(spark, pred_root).filter((F.col("dataset") == task.dataset) & F.col("array_name").isin(*some) & F.col("component").isin(*sorted(task.algorithms)))
    packed = packed.join(found.filter("problem is null").select("path", "array_name").distinct(), ["path", "array_name"], "left_semi")
    truth = read_npz(spark, truth_path) if truth_path else None
    return evaluate(cut(packed, "evaluation-rows"), cut(truth, "evaluation-truth") if truth is not None else None, pred_axes, truth_axes, task)
