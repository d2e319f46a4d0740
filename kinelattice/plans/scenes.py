"""More registered queries over the driver's tables: cameras, visibility, skeletons, display points, axes and batches.

The tables stand in as in ``catalog``; cameras are remainders of an order or vector number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelattice.functions import vec
from kinelattice.operators import align, cameras, detections, dyads, features, fusion, metrics, tables, temporal
from kinelattice.operators.results import Results
from kinelattice.plans.catalog import ORACLES, QUERIES, _B, _DAILY, _DOT, _E, _L, _LONG, _S, _boxed, _daily, _lines, _series, _slices, _values, _vectors, query, r6, read
from kinelattice.sources import frames


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# filters and series -------------------------------------------------------------------------------------------------


@query(f"SELECT metric_name, person, round(var_samp(value), 6) AS var, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM {_LONG} GROUP BY ALL")
def results_spread(spark, sf_dir):
    return _rounded(_values(spark, sf_dir).aggregate(["metric_name", "person"], ["var", "sem"], ordered=False), "var", "sem")


@query(" UNION ALL ".join(f"SELECT metric_name, person, {q}::DOUBLE AS q, round(quantile_cont(value, {q}), 6) AS quantile FROM {_LONG} GROUP BY ALL" for q in (0.05, 0.5, 0.95)))
def results_quantiles(spark, sf_dir):
    """Exact quantiles by metric and person, without holding a group."""
    return _rounded(_values(spark, sf_dir).quantiles(["metric_name", "person"], (0.05, 0.5, 0.95)), "quantile")


@query("SELECT CAST(order_year AS INT) AS year, round(avg(value), 6) AS value FROM (SELECT year(o_orderdate) AS order_year, o_totalprice AS value FROM orders) GROUP BY 1")
def results_other_levels(spark, sf_dir):
    """A view over levels of one's own, with one aggregate."""
    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"))
    return _rounded(Results.of(o, ("year",)).aggregate("year", "mean", ordered=False), "value")


@query(f"SELECT user_id, frame, x FROM {_S} WHERE conf > 0.1")
def confident_rows(spark, sf_dir):
    return detections.confident(_series(spark, sf_dir), "conf", 0.1).select("user_id", "frame", "x")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%2%'")
def labels_containing(spark, sf_dir):
    return align.labels_containing(read(spark, sf_dir, "part"), "2", "p_brand").select("p_partkey", "p_brand")


_ARRAYS = """(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'body_joints' WHEN 1 THEN 'gaze_interaction' ELSE 'other' END AS component,
 CASE p_partkey % 3 WHEN 0 THEN '3d' WHEN 1 THEN 'gaze_mutual_3d' ELSE '2d' END AS array_name FROM part)"""


@query(f"SELECT * FROM {_ARRAYS} WHERE (component = 'body_joints' AND array_name IN ('3d', '2d_interpolated')) OR (component = 'gaze_interaction' AND array_name IN ('gaze_look_at_3d', 'gaze_mutual_3d'))")
def allowed_arrays(spark, sf_dir):
    size, key = F.col("p_size") % 3, F.col("p_partkey") % 3
    p = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(size == 0, "body_joints").when(size == 1, "gaze_interaction").otherwise("other").alias("component"), F.when(key == 0, "3d").when(key == 1, "gaze_mutual_3d").otherwise("2d").alias("array_name")
    )
    return align.allowed_arrays(p)


@query(f"""SELECT user_id, frame, round(CASE WHEN p = frame - 1 THEN x - lag(x) OVER w END, 6) AS d_x FROM (
SELECT *, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS p FROM {_S} WHERE frame % 3 <> 0) WINDOW w AS (PARTITION BY user_id ORDER BY frame)""")
def displacement_adjacent(spark, sf_dir):
    """Movement over directly following frames only."""
    s = _series(spark, sf_dir).filter("frame % 3 <> 0")
    return _rounded(temporal.displacement(s, ["user_id"], ["x"], gaps="frame"), "d_x").select("user_id", "frame", "d_x")


_SEEN = f"(SELECT user_id, frame, CASE WHEN conf >= 0.06 OR conf IS NULL THEN x END AS x FROM {_S})"


@query(f"""SELECT user_id, frame, round(CASE WHEN t IS NOT NULL THEN x WHEN ta IS NOT NULL AND tb IS NOT NULL THEN xa + (xb - xa) * (frame - ta) / (tb - ta) ELSE x END, 6) AS x FROM (
SELECT *, last_value(t IGNORE NULLS) OVER p AS ta, last_value(CASE WHEN t IS NOT NULL THEN x END IGNORE NULLS) OVER p AS xa, first_value(t IGNORE NULLS) OVER f AS tb,
 first_value(CASE WHEN t IS NOT NULL THEN x END IGNORE NULLS) OVER f AS xb FROM (
SELECT *, CASE WHEN x IS NOT NULL AND (after IS NULL OR after - frame <= 10) THEN frame END AS t FROM (
SELECT *, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {_SEEN}))
WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def interpolate_compat(spark, sf_dir):
    """Gaps filled by the older tool's rule."""
    masked = temporal.mask_low_confidence(_series(spark, sf_dir), ["x"], "conf", 0.06)
    return _rounded(temporal.interpolate(masked, ["user_id"], ["x"], compat=True), "x").select("user_id", "frame", "x")


def _fit(window: int, order: int) -> str:
    """Row k: weights of the window's values in the fitted polynomial at k, from the normal equations."""
    t = np.vander(np.arange(window) - window // 2, order + 1).astype(float)
    return repr((t @ np.linalg.solve(t.T @ t, t.T)).tolist())


@query(f"""SELECT event_type, fs[k] AS frame, round(list_dot_product(xs[st + 1:st + 11], ({_fit(11, 2)})[k - st]), 6) AS smoothed FROM (
SELECT *, greatest(0, least(k - 6, len(xs) - 11)) AS st FROM (SELECT event_type, xs, fs, unnest(range(1, len(fs) + 1)) AS k FROM (
SELECT event_type, list(x ORDER BY frame) AS xs, list(frame ORDER BY frame) AS fs FROM {_DAILY} GROUP BY 1)))""")
def savgol(spark, sf_dir):
    return _rounded(temporal.savgol(_daily(spark, sf_dir), ["event_type"], "x"), "smoothed").select("event_type", "frame", "smoothed")


@query(f"SELECT user_id, frame, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS INT) AS position FROM {_S} WHERE frame % 4 <> 1")
def dense_positions(spark, sf_dir):
    s = _series(spark, sf_dir).filter("frame % 4 <> 1")
    return s.select("user_id", "frame", tables.dense_position("frame", ["user_id"]).alias("position"))


# labels and truth ---------------------------------------------------------------------------------------------------


@query("""SELECT p.label, CAST(p.pos AS INT) AS pred_pos, CAST(g.pos AS INT) AS gt_pos FROM (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS pos FROM (SELECT DISTINCT p_brand FROM part)) p
JOIN (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand DESC) - 1 AS pos FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 45)) g USING (label)""")
def common_labels(spark, sf_dir):
    """Labels of both sides with their positions."""
    part = read(spark, sf_dir, "part")
    axis = lambda df, order: df.select(F.col("p_brand").alias("label")).distinct().withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
    return align.common_labels(axis(part, F.col("label")), axis(part.filter("p_size > 45"), F.col("label").desc()))


@query("""SELECT n_nationkey, 's' || CAST(n_nationkey AS VARCHAR) AS session, CASE WHEN n_nationkey % 2 = 0 THEN 'q' || CAST(n_regionkey AS VARCHAR) END AS sequence, '3d' AS dim FROM nation""")
def truth_keys(spark, sf_dir):
    """Truth keys written and split again."""
    n = read(spark, sf_dir, "nation")
    middle = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("q"), F.col("n_regionkey").cast("string")))
    key = F.concat_ws("__", F.concat(F.lit("s"), F.col("n_nationkey").cast("string")), middle, F.lit("3d"))
    session, sequence, dim = align.split_truth_key(key)
    return n.select("n_nationkey", session.alias("session"), sequence.alias("sequence"), dim.alias("dim"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def missing_keys(spark, sf_dir):
    """Orders that the other side lacks."""
    large = read(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.missing_keys(read(spark, sf_dir, "orders"), large, ["o_orderkey"])


@query("""SELECT d.dataset, m.component, m.algorithm FROM (SELECT DISTINCT n_name AS dataset, CASE n_regionkey WHEN 0 THEN 'body' WHEN 1 THEN 'gaze' ELSE 'face' END AS component FROM nation) d
JOIN (VALUES ('body', 'a1'), ('body', 'a2'), ('gaze', 'g1')) AS m(component, algorithm) USING (component)""")
def evaluation_entries(spark, sf_dir):
    """The algorithms that each dataset's components are evaluated with."""
    region = F.col("n_regionkey")
    wanted = read(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), F.when(region == 0, "body").when(region == 1, "gaze").otherwise("face").alias("component"))
    return align.evaluation_entries(wanted, {"body": ["a1", "a2"], "gaze": ["g1"]})


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS frames FROM lineitem GROUP BY 1")
def work_total(spark, sf_dir):
    """Frames to process, from the lengths of parts."""
    return tables.work_total(read(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"])


@query(f"SELECT a.label, round(avg(list_distance(a.v, b.v)), 6) AS jpe FROM {_E} a LEFT JOIN (SELECT vec_id - 1 AS vec_id, v FROM {_E}) b ON b.vec_id = a.vec_id GROUP BY 1")
def joint_error_summary(spark, sf_dir):
    """The joint error of every vector against the next one, by label."""
    pred = _vectors(spark, sf_dir)
    gt = pred.select((F.col("vec_id") - 1).alias("vec_id"), "v").join(pred.select("vec_id", "label"), "vec_id")
    return _rounded(metrics.JointError(("vec_id", "label"), ("label",)).plan(pred, gt)[1], "jpe")


_AGREE = "(SELECT d.source, l.toxic <> 0 AS p, l.quality <> 0 AS g FROM labels l JOIN documents d USING (doc_id))"


@query(f"""SELECT source, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT source, count_if(p AND g) AS tp, count_if(NOT p AND NOT g) AS tn, count_if(p AND NOT g) AS fp, count_if(NOT p AND g) AS fn FROM {_AGREE} GROUP BY 1)""")
def agreement_summary(spark, sf_dir):
    """Two flags of a document set against each other, by source."""
    labels = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    side = lambda c: labels.select("doc_id", "source", F.col(c).alias("v"))
    out = metrics.Agreement(("doc_id", "source"), ("source",)).plan(side("toxic"), side("quality"))[1]
    return _rounded(out, "accuracy", "precision", "recall", "f1")


# cameras and visibility ---------------------------------------------------------------------------------------------

_TURN = [[0.9210609940028851, 0.0, 0.3894183423086505], [0.0, 1.0, 0.0], [-0.3894183423086505, 0.0, 0.9210609940028851]]
_PLAIN = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
_TURNED = "[" + ", ".join("+".join(f"({c}) * {{0}}[{j + 1}]" for j, c in enumerate(row)) for row in _TURN) + "]"


@query(f"""SELECT vec_id, camera, CAST(-trunc(-w / 5 * sin(yaw) * cos(pitch)) AS INT) AS dx, CAST(-trunc(-w / 5 * sin(pitch)) AS INT) AS dy FROM (
SELECT vec_id, camera, w, asin(-u[2] / sqrt({_DOT.format("u", "u")})) AS pitch, atan2(-u[1], -u[3]) AS yaw FROM (
SELECT vec_id, 'c1' AS camera, 1920.0::DOUBLE AS w, v[1:3] AS u FROM {_E} UNION ALL SELECT vec_id, 'c2', 1280.0::DOUBLE, {_TURNED.format("v")} FROM {_E}))""")
def projected_gaze(spark, sf_dir):
    """Gaze vectors in the images of two cameras."""
    table = spark.createDataFrame([("c1", _PLAIN, 1920.0), ("c2", _TURN, 1280.0)], "camera string, R array<array<double>>, image_width double")
    return fusion.project_gaze(_vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 3).alias("fused")), table, ["vec_id"])


@query(f"""SELECT session, vec_id, camera, CAST(-trunc(-w / 5 * sin(yaw) * cos(pitch)) AS INT) AS dx, CAST(-trunc(-w / 5 * sin(pitch)) AS INT) AS dy FROM (
SELECT session, vec_id, camera, w, asin(-u[2] / sqrt({_DOT.format("u", "u")})) AS pitch, atan2(-u[1], -u[3]) AS yaw FROM (
SELECT 's0' AS session, vec_id, 'c1' AS camera, 1920.0::DOUBLE AS w, v[1:3] AS u FROM {_E} WHERE vec_id % 2 = 0 UNION ALL SELECT 's0', vec_id, 'c2', 1280.0::DOUBLE, {_TURNED.format("v")} FROM {_E} WHERE vec_id % 2 = 0
UNION ALL SELECT 's1', vec_id, 'c1', 640.0::DOUBLE, {_TURNED.format("v")} FROM {_E} WHERE vec_id % 2 = 1))""")
def projected_sessions(spark, sf_dir):
    """Gaze vectors of two sessions, each in the images of its own cameras."""
    table = spark.createDataFrame([("s0", "c1", _PLAIN, 1920.0), ("s0", "c2", _TURN, 1280.0), ("s1", "c1", _TURN, 640.0)], "session string, camera string, R array<array<double>>, image_width double")
    session = F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string"))
    gaze = _vectors(spark, sf_dir).select(session.alias("session"), "vec_id", F.slice("v", 1, 3).alias("fused"))
    return fusion.project_gaze(gaze, table, ["vec_id"], session=["session"])


_RIGS = {
    "s0": {"c1": {"K": [[800.0, 0, 320], [0, 800, 240], [0, 0, 1]], "r": [0.0, 0, 0], "t": [0.0, 0, 10], "d": [0.1, -0.05, 0.002, -0.001, 0.01]}, "c2": {"K": [[700.0, 0, 300], [0, 720, 250], [0, 0, 1]], "r": [0.0, 0.4, 0], "t": [-3.0, 0, 11]}},
    "s1": {"c1": {"K": [[900.0, 0, 400], [0, 900, 300], [0, 0, 1]], "r": [0.3, 0.1, 0], "t": [1.0, 0.5, 9]}, "c3": {"K": [[650.0, 0, 310], [0, 640, 230], [0, 0, 1]], "r": [0.0, -0.5, 0.1], "t": [2.0, 0, 12], "d": [-0.2, 0.02, 0.0, 0.001, 0.0]}},
}


@query(f"SELECT 's' || CAST(vec_id % 2 AS VARCHAR) AS session, vec_id, round(v[1], 4) AS x, round(v[2], 4) AS y, round(v[3], 4) AS z, 0.9::DOUBLE AS conf FROM {_E}")
def triangulated_sessions(spark, sf_dir):
    """Points of two sessions, seen by each session's own distorting cameras and brought back to 3-D."""
    made = [(s, c, cameras.complete(own)) for s, rig in _RIGS.items() for c, own in rig.items()]
    table = spark.createDataFrame([(s, c, *(m[n].tolist() for n in ("K", "R", "Rt", "P", "d"))) for s, c, m in made], "session string, camera string, K array<array<double>>, R array<array<double>>, Rt array<array<double>>, P array<array<double>>, dist array<double>")
    points = _vectors(spark, sf_dir).select("vec_id", F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("session"), F.concat(F.slice("v", 1, 3), F.array(F.lit(1.0))).alias("point"))
    h = points.join(F.broadcast(table), "session").withColumn("h", vec.matvec(F.col("P"), F.col("point")))  # four cameras
    x, y = cameras.distorted(*(F.element_at("h", k) / F.element_at("h", 3) for k in (1, 2)), F.col("K"), F.col("dist"))
    seen = h.select("session", "vec_id", "camera", x.alias("x"), y.alias("y"), F.lit(0.9).alias("conf"))
    return _rounded4(cameras.triangulate_sessions(seen, table, ["vec_id"], ["session"]))


def _rounded4(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in "xyz"})


@query(f"""SELECT vec_id, round(w[1] / n, 6) AS x, round(w[2] / n, 6) AS y, round(w[3] / n, 6) AS z FROM (SELECT *, sqrt({_DOT.format("w", "w")}) AS n FROM (
SELECT vec_id, [{", ".join("+".join(f"({_TURN[j][i]}) * v[{j + 1}]" for j in range(3)) for i in range(3))}] AS w FROM {_E}))""")
def world_directions(spark, sf_dir):
    """Camera-frame directions in world axes."""
    rotation = F.array(*(F.array(*(F.lit(x) for x in row)) for row in _TURN))
    w = cameras.world_direction(rotation, F.slice("v", 1, 3))
    return _vectors(spark, sf_dir).select("vec_id", *(r6(F.element_at(w, k + 1)).alias(c) for k, c in enumerate("xyz")))


_SIDES = ("l_extendedprice", "l_discount", "l_tax")


@query(f"""SELECT l_orderkey, {", ".join(f"round({c} / nullif(n, 0), 6) AS {c}" for c in "xyz")} FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (
SELECT l_orderkey, {", ".join(f"sum({c} * w) / nullif(sum(w), 0) AS {n}" for c, n in zip(_SIDES, "xyz"))} FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 1.0 END AS w FROM lineitem) GROUP BY 1))""")
def ensemble(spark, sf_dir):
    """Fusion over two algorithms' cameras; the second has no confidence, so it weighs 1."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SIDES, F.col("l_quantity").alias("conf"))
    inputs = [li.filter("l_linenumber % 2 = 1"), li.filter("l_linenumber % 2 = 0").drop("conf")]
    out = fusion.ensemble(inputs, ["l_orderkey"], list(_SIDES), "conf")
    return out.select("l_orderkey", *(r6(F.element_at("fused", k + 1)).alias(c) for k, c in enumerate("xyz")))


@query("SELECT l_orderkey, " + ", ".join(f"round(avg({c}), 6) AS {n}" for c, n in zip(_SIDES, "xyz")) + " FROM lineitem GROUP BY 1")
def camera_mean(spark, sf_dir):
    """The mean over cameras as it is, without unit length."""
    out = fusion.fuse_mean(read(spark, sf_dir, "lineitem"), ["l_orderkey"], list(_SIDES), normalise=False)
    return out.select("l_orderkey", *(r6(F.element_at("fused", k + 1)).alias(c) for k, c in enumerate("xyz")))


_SEES = [(0, 0, 1), (0, 1, 0), (1, 0, 0), (2, 0, 2), (2, 1, 1), (2, 2, 0)]
_SEES_SQL = "(VALUES " + ", ".join(map(str, _SEES)) + ") AS s(camera, rank, subject_pos)"
_RANKED = f"(SELECT l_orderkey % 3 AS camera, l_orderkey, person, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, person) - 1 AS rank FROM {_L})"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select((F.col("l_orderkey") % 3).alias("camera"), "l_orderkey", "person", F.col("l_quantity").alias("x1"))


def _sees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SEES, "camera long, rank int, subject_pos int")


@query(f"SELECT camera, l_orderkey, person, CAST(subject_pos AS INT) AS subject FROM {_RANKED} JOIN {_SEES_SQL} USING (camera, rank)")
def visible_subjects(spark, sf_dir):
    """Detections from left to right as the subjects that their camera sees."""
    return detections.assign_visible(_detected(spark, sf_dir), ["camera", "l_orderkey"], _sees(spark), tie="person").drop("x1")


@query(f"SELECT camera, l_orderkey, person, CAST(coalesce(subject_pos, rank) AS INT) AS subject FROM {_RANKED} LEFT JOIN {_SEES_SQL} USING (camera, rank) WHERE coalesce(subject_pos, rank) < 3")
def visible_subjects_fallback(spark, sf_dir):
    return detections.assign_visible(_detected(spark, sf_dir), ["camera", "l_orderkey"], _sees(spark), tie="person", fallback=3).drop("x1")


@query(f"SELECT camera, l_orderkey, person, CAST(rank AS INT) AS subject FROM {_RANKED} WHERE (camera, rank) IN (SELECT (camera, subject_pos) FROM {_SEES_SQL})")
def visible_only(spark, sf_dir):
    ranked = detections.left_to_right(_detected(spark, sf_dir), ["camera", "l_orderkey"], tie="person").drop("x1")
    return detections.visible_only(ranked, _sees(spark)).select("camera", "l_orderkey", "person", "subject")


_TRIG = "SELECT *, " + ", ".join(f"{f}(radians({x})) AS {n}" for n, f, x in (("cy", "cos", "yaw - 90"), ("sy", "sin", "yaw - 90"), ("cp", "cos", "pitch"), ("sp", "sin", "pitch"), ("cr", "cos", "roll + 90"), ("sr", "sin", "roll + 90")))


@query(f"""SELECT vec_id, {", ".join(f"round({e}, 6) AS {n}" for n, e in (
    ("x1", "nx + 100 * cy * cp"), ("y1", "ny + 100 * sp"), ("x2", "nx - 50 * (sy * sr - cy * sp * cr)"), ("y2", "ny - 50 * cp * cr"), ("x3", "nx - 50 * (cy * sp * sr + sy * cr)"), ("y3", "ny + 50 * cp * sr")))}
FROM ({_TRIG} FROM (SELECT vec_id, v[1] * 90 AS yaw, v[2] * 60 AS pitch, v[3] * 30 AS roll, v[4] * 100 AS nx, v[5] * 100 AS ny FROM {_E}))""")
def head_axes(spark, sf_dir):
    """End points of the head's axes in the image."""
    at = lambda k: F.element_at("v", k)
    ends = cameras.head_axes(at(1) * 90, at(2) * 60, at(3) * 30, at(4) * 100, at(5) * 100)
    return _vectors(spark, sf_dir).select("vec_id", ends.alias("e")).select("vec_id", *(r6(F.element_at("e", k + 3)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2", "x3", "y3"))))


# detections ---------------------------------------------------------------------------------------------------------

_SCORED = f"(SELECT l_orderkey % 50 AS camera, l_orderkey AS frame, person AS pos, x1, y1, x2, y2, ((l_orderkey * 31 + person * 17) % 100) / 100.0::DOUBLE AS score FROM {_B})"
_OVER = """list_transform(range(i + 1, len(b) + 1), lambda j: {'i': i, 'j': j, 'lose': CASE WHEN b[j].score < b[i].score THEN j ELSE i END, 'gone': []::BIGINT[], 'over':
 coalesce(greatest(least(b[i].x2, b[j].x2) - greatest(b[i].x1, b[j].x1), 0) * greatest(least(b[i].y2, b[j].y2) - greatest(b[i].y1, b[j].y1), 0)
 / nullif((b[i].x2 - b[i].x1) * (b[i].y2 - b[i].y1) + (b[j].x2 - b[j].x1) * (b[j].y2 - b[j].y1)
 - greatest(least(b[i].x2, b[j].x2) - greatest(b[i].x1, b[j].x1), 0) * greatest(least(b[i].y2, b[j].y2) - greatest(b[i].y1, b[j].y1), 0), 0) > {threshold}, FALSE)})"""
_KEPT = """SELECT camera, frame, list_filter(b, lambda x, k: NOT list_contains(gone, k)) AS kept, b FROM (
SELECT *, list_reduce(list_prepend({'i': 0::BIGINT, 'j': 0::BIGINT, 'lose': 0::BIGINT, 'gone': []::BIGINT[], 'over': FALSE}, flatten(list_transform(range(1, len(b) + 1), lambda i: OVER))),
 lambda a, x: {'i': x.i, 'j': x.j, 'lose': x.lose, 'gone': CASE WHEN x.over AND NOT list_contains(a.gone, x.i) AND NOT list_contains(a.gone, x.j) THEN list_append(a.gone, x.lose) ELSE a.gone END, 'over': x.over}).gone AS gone FROM (
SELECT camera, frame, list({'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score} ORDER BY pos) AS b FROM SCORED GROUP BY ALL))"""


def _kept(threshold: float, scored: str) -> str:
    return "(" + _KEPT.replace("OVER))", _OVER.replace("{threshold}", str(threshold)) + "))").replace("SCORED", scored) + ")"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ((F.col("l_orderkey") * 31 + F.col("person") * 17) % 100) / 100.0
    return _boxed(spark, sf_dir).select((F.col("l_orderkey") % 50).alias("camera"), F.col("l_orderkey").alias("frame"), F.col("person").alias("pos"), "x1", "y1", "x2", "y2", score.alias("score"))


@query(f"SELECT camera, frame, unnest(list_transform(kept, lambda x: x.pos)) AS pos FROM {_kept(0.5, _SCORED)}")
def suppressed_overlaps(spark, sf_dir):
    """Boxes left when of each pair that overlaps by more than half the lower score goes."""
    return detections.suppress_overlaps(_scored(spark, sf_dir), ["camera", "frame"], 0.5).select("camera", "frame", "pos")


@query(f"""SELECT camera, frame, CAST(len(people) AS INT) AS n, array_to_string(list_transform(people, lambda x: CAST(x.pos AS VARCHAR)), ',') AS people FROM (
SELECT f.camera, f.frame, coalesce(last_value(CASE WHEN len(p) = 2 THEN list_sort(list_transform(p, lambda x: {{'x1': x.x1, 'pos': x.pos}})) END IGNORE NULLS)
 OVER (PARTITION BY f.camera ORDER BY f.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), []) AS people FROM (SELECT DISTINCT camera, frame FROM {_SCORED}) f
LEFT JOIN (SELECT camera, frame, CASE WHEN len(b) = 2 THEN b ELSE kept END AS p FROM {_kept(0.5, f"(SELECT * FROM {_SCORED} WHERE score > 0.3)")}) k ON f.camera = k.camera AND f.frame = k.frame)""")
def corrected_people(spark, sf_dir):
    """Detections of an order's lines: confident, suppressed, ordered, and carried over where their number is wrong."""
    out = detections.correct_people(_scored(spark, sf_dir), ["camera"], "frame", 2, above=0.3, threshold=0.5)
    return out.select("camera", "frame", F.size("people").alias("n"), F.array_join(F.transform("people", lambda p: p["pos"].cast("string")), ",").alias("people"))


# points, skeletons and display --------------------------------------------------------------------------------------


def _joints(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """vec_id, pos, label, x, y, z: consecutive triples of a vector."""
    joints = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f"k{i}").alias("label"), *(F.element_at("v", 3 * i + c).alias(x) for c, x in ((1, "x"), (2, "y"), (3, "z")))) for i in range(n)))
    return _vectors(spark, sf_dir).select("vec_id", F.inline(joints))


_J = "(" + " UNION ALL ".join(f"SELECT vec_id, {i} AS pos, 'k{i}' AS label, v[{3 * i + 1}] AS x, v[{3 * i + 2}] AS y, v[{3 * i + 3}] AS z FROM {_E}" for i in range(6)) + ")"
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in "xyz")


@query(f"SELECT vec_id, {_MEANS} FROM {_J} WHERE label IN ('k0', 'k1') GROUP BY 1")
def mid_points(spark, sf_dir):
    return _rounded(fusion.mid_point(_joints(spark, sf_dir), ["vec_id"], ["x", "y", "z"], ["k0", "k1"]), "x", "y", "z")


@query(f"SELECT vec_id, {_MEANS} FROM {_J} WHERE pos < 4 GROUP BY 1")
def eye_regions(spark, sf_dir):
    return _rounded(fusion.eye_region(_joints(spark, sf_dir), ["vec_id"], ["x", "y", "z"]), "x", "y", "z")


@query(f"SELECT label, {_MEANS} FROM {_J} GROUP BY 1")
def time_means(spark, sf_dir):
    """The mean point of every joint over all frames."""
    return _rounded(fusion.time_mean(_joints(spark, sf_dir), ["label"], ["x", "y", "z"]), "x", "y", "z")


@query(f"SELECT vec_id, round(avg(z), 6) AS face_conf FROM {_J} GROUP BY 1")
def face_confidences(spark, sf_dir):
    return _rounded(fusion.face_confidence(_joints(spark, sf_dir), ["vec_id"], "z"), "face_conf")


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 = 0 THEN 900.0 * (o_orderkey % 2 + 1) / 3 ELSE o_totalprice END, 6) AS x, round(CASE WHEN o_orderkey % 7 = 0 THEN 200.0 ELSE o_totalprice / 2 END, 6) AS y FROM orders""")
def face_centres(spark, sf_dir):
    """Display centres, with image thirds where there is none."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    x, y = fusion.face_centre(F.when(k % 5 != 0, v), F.when(k % 7 != 0, v / 2), k % 2, F.lit(900.0), F.lit(600.0))
    return read(spark, sf_dir, "orders").select("o_orderkey", r6(x).alias("x"), r6(y).alias("y"))


@query(f"SELECT vec_id, round(-v[1] / 2, 6) AS x, round(-v[2] / 2, 6) AS y, round(-v[3] / 2, 6) AS z FROM {_E}")
def display_arrows(spark, sf_dir):
    arrow = fusion.display_arrow(F.slice("v", 1, 3))
    return _vectors(spark, sf_dir).select("vec_id", *(r6(F.element_at(arrow, k + 1)).alias(c) for k, c in enumerate("xyz")))


@query(f"""SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN 'right' ELSE 'left' END AS other, round((p[1] + l[1]) / 2 - d / 2, 6) AS bar_x1, round((p[2] + l[2]) / 2 - 0.5, 6) AS bar_y1, round((p[1] + l[1]) / 2 + d / 2, 6) AS bar_x2,
 round((p[2] + l[2]) / 2 - 0.5, 6) AS bar_y2 FROM (SELECT vec_id, v[1:3] AS p, v[4:6] AS l, abs(v[7]) AS d FROM {_E})""")
def proximity_bars(spark, sf_dir):
    """Bars between two people, and who the other one is."""
    at = lambda c, k: F.element_at(c, k)
    bar = dyads.proximity_bar(at("p", 1), at("p", 2), at("l", 1), at("l", 2), F.abs(at("d", 1)), 0.5)
    person = F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right")
    return _slices(spark, sf_dir).select("vec_id", dyads.other_person(person, F.lit("left"), F.lit("right")).alias("other"), *(r6(c).alias(n) for n, c in bar.items()))


_EDGES = "(VALUES ('arm', 'k0', 'k1'), ('arm', 'k1', 'k2'), ('leg', 'k3', 'k4')) AS e(line, a, b)"


@query(f"SELECT p.vec_id, e.line, e.a AS start, e.b AS end, {', '.join(f'round(p.{c}, 6) AS {c}_a, round(q.{c}, 6) AS {c}_b' for c in 'xy')} FROM {_J} p JOIN {_EDGES} ON p.label = e.a JOIN {_J} q ON q.label = e.b AND q.vec_id = p.vec_id")
def skeleton_edges(spark, sf_dir):
    """Both ends of every edge of the polylines."""
    lines = spark.createDataFrame([("arm", ["k0", "k1", "k2"]), ("leg", ["k3", "k4"]), ("dot", ["k5"])], "line string, joints array<string>")
    out = tables.edge_points(_joints(spark, sf_dir).drop("pos"), tables.polyline_edges(lines), ["vec_id"], ["x", "y"])
    return _rounded(out, "x_a", "x_b", "y_a", "y_b").select("vec_id", "line", "start", "end", "x_a", "x_b", "y_a", "y_b")


@query(f"SELECT vec_id, CAST(k - 1 AS INT) AS pos, 'k' || CAST(k - 1 AS VARCHAR) AS label, round(v[k], 6) AS value FROM {_E}, (SELECT unnest(range(1, 9)) AS k)")
def exploded_axis(spark, sf_dir):
    """Packed arrays as rows, with the names of their axis; places without a name are left out."""
    axis = spark.createDataFrame([(k, f"k{k}") for k in range(8)], "pos int, label string")
    out = tables.explode_axis(_vectors(spark, sf_dir).select("vec_id", "v"), "v", axis)
    return out.select("vec_id", "pos", "label", r6("value").alias("value"))


def _mids(a: int, b: int) -> str:
    return "[" + ", ".join(f"(v[{a + k}] + v[{b + k}]) / 2" for k in range(3)) + "]"


_LEAN = f"(SELECT label AS person, vec_id AS frame, {_mids(1, 4)} AS a, {_mids(7, 10)} AS b, {_mids(13, 16)} AS c FROM {_E})"
_BENT = f"""(SELECT person, frame, degrees(acos(greatest(-1, least(1, {_DOT.format("p", "q")} / nullif(sqrt({_DOT.format("p", "p")}) * sqrt({_DOT.format("q", "q")}), 0))))) AS angle FROM (
SELECT person, frame, [b[1] - a[1], b[2] - a[2], b[3] - a[3]] AS p, [c[1] - b[1], c[2] - b[2], c[3] - b[3]] AS q FROM {_LEAN}))"""


@query(f"""SELECT person, frame, round(angle, 6) AS angle, round(CASE WHEN n < 2 THEN NULL WHEN k = 1 THEN after - angle WHEN k = n THEN angle - before ELSE (after - before) / 2 END, 6) AS gradient FROM (
SELECT *, lag(angle) OVER w AS before, lead(angle) OVER w AS after, row_number() OVER w AS k, count(*) OVER (PARTITION BY person) AS n FROM {_BENT} WINDOW w AS (PARTITION BY person ORDER BY frame))""")
def leaning(spark, sf_dir):
    """Body angle over three midpoints of joints, with its gradient along the vectors of a label."""
    points = _joints(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", F.col("label").alias("person")), "vec_id")
    points = points.select("person", F.col("vec_id").alias("frame"), "label", F.array("x", "y", "z").alias("v"))
    out = features.leaning(points, ["person", "frame"], [("k0", "k1"), ("k2", "k3"), ("k4", "k5")])
    return _rounded(out, "angle", "gradient").select("person", "frame", "angle", "gradient")


# images and batches -------------------------------------------------------------------------------------------------


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    idx = F.floor(k / 2).cast("int")
    camera = F.concat(F.lit("c"), (k % 2).cast("string"))
    e = read(spark, sf_dir, "embeddings").select(idx.alias("frame_idx"), (idx + 100).alias("frame"), camera.alias("camera"))
    return e.withColumn("path", F.format_string("%s/%09d.png", "camera", "frame"))


_IMAGES = "(SELECT vec_id // 2 AS frame_idx, vec_id // 2 + 100 AS frame, 'c' || CAST(vec_id % 2 AS VARCHAR) AS camera, 'c' || CAST(vec_id % 2 AS VARCHAR) || '/' || lpad(CAST(vec_id // 2 + 100 AS VARCHAR), 9, '0') || '.png' AS path FROM embeddings)"


@query(f"SELECT CAST(frame_idx // 16 AS INT) AS batch, CAST(frame_idx AS INT) AS frame_idx, CAST(frame AS INT) AS frame, string_agg(path, ' ' ORDER BY camera) AS images FROM {_IMAGES} GROUP BY ALL")
def frame_batches(spark, sf_dir):
    """Batches of 16 frames with the images of all cameras."""
    out = frames.batches(_images(spark, sf_dir), 16).select("batch", F.inline("frames"))
    return out.select("batch", "frame_idx", "frame", F.array_join(F.transform("images", lambda x: x["value"]), " ").alias("images"))


@query(f"SELECT camera, CAST(count(*) AS BIGINT) AS n, min(path) AS first, max(path) AS last FROM {_IMAGES} GROUP BY 1")
def camera_images(spark, sf_dir):
    """Every camera's images in frame order."""
    out = frames.by_camera(_images(spark, sf_dir))
    return out.select("camera", F.size("images").cast("bigint").alias("n"), F.element_at("images", 1).alias("first"), F.element_at("images", -1).alias("last"))


@query(f"SELECT d.vec_id, i.camera, CAST(i.frame AS INT) AS frame FROM (SELECT vec_id, 'c' || CAST(vec_id % 3 AS VARCHAR) || '/' || lpad(CAST(vec_id // 2 + 100 AS VARCHAR), 9, '0') || '.png' AS path FROM embeddings) d JOIN {_IMAGES} i USING (path)")
def detections_by_path(spark, sf_dir):
    """Detector rows find their image by its path; rows of unknown paths go."""
    name = F.format_string("c%d/%09d.png", F.col("vec_id") % 3, F.floor(F.col("vec_id") / 2) + 100)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", name.alias("path"))
    return frames.rows_by_path(rows, _images(spark, sf_dir)).select("vec_id", "camera", "frame")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE trunc(p_retailprice / 30) END AS INT) AS fps FROM part")
def integer_fps(spark, sf_dir):
    rate = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice") / 30)
    return read(spark, sf_dir, "part").select("p_partkey", frames.integer_fps(rate).alias("fps"))


# series in blocks ---------------------------------------------------------------------------------------------------

_BLOCK = 16


def _blocked(name: str, f) -> None:
    """Register a query's form over blocks of a series, with the same SQL."""
    QUERIES[f"{name}_blocks"] = f
    ORACLES[f"{name}_blocks"] = ORACLES[name]


_blocked("velocity", lambda spark, d: _rounded(temporal.velocity(_series(spark, d), ["user_id"], ["x", "y"], 30.0, "conf", block=_BLOCK), "velocity", "min_conf").select("user_id", "frame", "velocity", "min_conf"))
_blocked("gradient", lambda spark, d: _rounded(temporal.gradient(_series(spark, d), ["user_id"], "x", block=_BLOCK), "gradient").select("user_id", "frame", "gradient"))
_blocked("savgol", lambda spark, d: _rounded(temporal.savgol(_daily(spark, d), ["event_type"], "x", block=_BLOCK), "smoothed").select("event_type", "frame", "smoothed"))
_blocked("conf_mask_interp", lambda spark, d: _rounded(temporal.interpolate(temporal.mask_low_confidence(_series(spark, d), ["x"], "conf", 0.06), ["user_id"], ["x"], block=_BLOCK), "x").select("user_id", "frame", "x"))
_blocked("interpolate_compat", lambda spark, d: _rounded(temporal.interpolate(temporal.mask_low_confidence(_series(spark, d), ["x"], "conf", 0.06), ["user_id"], ["x"], compat=True, block=_BLOCK), "x").select("user_id", "frame", "x"))
_blocked("carry_forward", lambda spark, d: temporal.carry_forward(read(spark, d, "conversations"), ["conv_id"], "text", F.col("role") != "assistant", "turn", block=_BLOCK).select("conv_id", "turn", "carried"))
