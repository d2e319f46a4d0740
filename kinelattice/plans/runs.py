"""Registered queries of whole evaluation runs, over ``embeddings`` as packed arrays of two sessions.

A vector is a frame with four joints j0 to j3 (numbers 1 to 12); numbers 34 to 42 are the truth of j1 to j3, which has its
labels and coordinates in another order, one label under a synonym, and no frame whose number is a multiple of 7.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelattice.operators import evaluation, states
from kinelattice.plans.catalog import _BONE_SQL, _CONFUSION, _E, _JUMPS, _LIMITS, _bone_lengths, _confusion, _series, query, r6, read

_BONES = {"upper": ("j0", "j1"), "lower": ("j1", "j2"), "span": ("j0", "j3")}
_DIAMETERS = {"j0": 0.0002, "j1": 0.0003, "j2": 0.0004}


def _packed(spark: SparkSession, sf_dir: str, truth: bool) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    session = F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string"))
    name = {1: "one"} if truth else {}
    point = lambda k: F.reverse(F.slice("e", 31 + 3 * k, 3)) if truth else F.slice("e", 1 + 3 * k, 3)
    joints = F.array(*(F.struct(F.lit(name.get(k, f"j{k}")).alias("label"), point(k).alias("v")) for k in ((3, 2, 1) if truth else range(4))))
    text = lambda x: F.lit(x).cast("string")
    rows = (e.filter("vec_id % 7 <> 0") if truth else e).select("vec_id", F.concat(F.lit("p"), F.col("label").cast("string")).alias("person"), session.alias("session"), F.explode(joints).alias("j"))
    return rows.select(
        F.concat(F.lit("truth" if truth else "pred-"), F.lit("") if truth else F.col("session")).alias("path"), text("vectors").alias("dataset"), text(None).alias("session") if truth else "session", text(None).alias("sequence"),
        text("body_joints").alias("component"), text("net").alias("algorithm"), (F.concat("session", F.lit("__3d")) if truth else F.lit("3d")).alias("array_name"), "person", F.lit("3d").alias("camera"),
        F.col("vec_id").cast("int").alias("frame"), F.col("j.label").alias("label"), F.col("j.v").alias("v"), (F.lit(None) if truth else F.lit(0.9)).cast("double").alias("conf"),
        F.array(*(F.lit(c) for c in ("zyx" if truth else "xyz"))).alias("axis"),
    )


def _run(spark: SparkSession, sf_dir: str) -> evaluation.EvaluationRun:
    types = (
        evaluation.MetricType("point_cloud_metrics", ("jpe",), ("body_joints",), True),
        evaluation.MetricType("keypoint_metrics", ("bone_length", "jump_detection"), ("body_joints",)),
    )
    videos = (evaluation.Video("s0"), evaluation.Video("s1"))
    task = evaluation.Task("vectors", videos, types, {"body_joints": ("net",)}, {"axis3": {"one": "j1"}}, _BONES, _DIAMETERS)
    pred, truth = _packed(spark, sf_dir, False), _packed(spark, sf_dir, True)
    return evaluation.evaluate(pred, truth, evaluation.axes_of(pred), evaluation.axes_of(truth), task)


_P = " UNION ALL ".join(f"SELECT vec_id AS frame, 's' || CAST(vec_id % 2 AS VARCHAR) AS session, 'p' || CAST(label AS VARCHAR) AS person, 'j{k}' AS label, v[{1 + 3 * k}:{3 + 3 * k}] AS v, v[{31 + 3 * k}:{33 + 3 * k}] AS t FROM {_E}" for k in range(4))
_BONE = " UNION ALL ".join(f"SELECT a.session, a.person, a.frame, '{n}' AS label, list_distance(a.v, b.v) AS value FROM ({_P}) a JOIN ({_P}) b ON a.frame = b.frame AND a.label = '{x}' AND b.label = '{y}'" for n, (x, y) in _BONES.items())
_JUMP = f"""(SELECT session, person, frame, label, CAST(coalesce(list_distance(v, p) > lim * 1000, FALSE) AS DOUBLE) AS value FROM (
SELECT *, lag(v) OVER (PARTITION BY session, person, label ORDER BY frame) AS p FROM ({_P})) LEFT JOIN (VALUES {", ".join(f"('{j}', {d})" for j, d in _DIAMETERS.items())}) AS l(label, lim) USING (label) WHERE p IS NOT NULL)"""


@query(f"""SELECT metric_name, session, person, CAST(frame AS INT) AS frame, label, round(value, 6) AS value FROM (
SELECT 'jpe' AS metric_name, session, person, frame, label, CASE WHEN frame % 7 <> 0 THEN list_distance(v, t) END AS value FROM ({_P}) WHERE label <> 'j0'
UNION ALL SELECT 'bone_length', * FROM ({_BONE}) UNION ALL SELECT 'jump_detection', * FROM {_JUMP})""")
def evaluation_frames(spark, sf_dir):
    """Frame values of joint error, bone length and jumps of a run."""
    return _run(spark, sf_dir).frames.select("metric_name", "session", "person", "frame", "label", r6("value").alias("value"))


@query(f"""SELECT person, '3d' AS camera, 'mean_bone_length__' || label AS metric, round(avg(value), 6) AS value FROM ({_BONE}) GROUP BY ALL
UNION ALL SELECT person, '3d', 'std_bone_length__' || label, round(stddev_samp(value), 6) FROM ({_BONE}) GROUP BY ALL
UNION ALL SELECT person, '3d', 'jump_count', sum(value) FROM {_JUMP} GROUP BY ALL""")
def evaluation_summary(spark, sf_dir):
    """Summaries of the same run."""
    return _run(spark, sf_dir).summary.select("person", "camera", "metric", r6("value").alias("value"))


# states of parts ----------------------------------------------------------------------------------------------------


def _merged(kind: states.States, parts: list[DataFrame]) -> DataFrame:
    """States of every part, merged two by two, then computed."""
    own = [kind.update(p) for p in parts]
    return kind.compute(reduce(kind.merge, own))


@query(f"SELECT label AS person, bone, round(avg(bone_length), 6) AS mean, round(stddev_samp(bone_length), 6) AS std FROM ({_BONE_SQL}) GROUP BY ALL")
def bone_states(spark, sf_dir):
    """Bone statistics from the states of three parts of the rows."""
    lengths = _bone_lengths(spark, sf_dir)
    out = _merged(states.Moments(("person", "bone"), "bone_length"), [lengths.filter(F.col("vec_id") % 3 == k) for k in range(3)])
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(f"SELECT user_id, event_type, CAST(count_if(jump) AS DOUBLE) AS jump_count FROM ({_JUMPS}) GROUP BY ALL")
def jump_states(spark, sf_dir):
    """Jumps from the states of frame ranges, borders between them included."""
    kind = states.Jumps(("user_id", "event_type"), ("x",), spark.createDataFrame(_LIMITS, "event_type string, diameter double"), "event_type", "diameter", ("user_id", "event_type"))
    frames = _series(spark, sf_dir)
    return _merged(kind, [frames.filter(F.col("frame") >= 40), frames.filter(F.col("frame") < 15), frames.filter((F.col("frame") >= 15) & (F.col("frame") < 40))])


@query(f"""SELECT source, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1
FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (SELECT source, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM {_CONFUSION} GROUP BY 1))""")
def score_states(spark, sf_dir):
    """Scores by source from the counts of each language."""
    kind = states.Counts(("source",))
    counts = _confusion(spark, sf_dir)
    langs = (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True)))
    return _merged(kind, [counts.filter(c) for c in langs]).select("source", *(r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))
