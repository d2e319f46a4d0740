"""Registered queries over the driver's tables and their SQL counterparts.

The tables stand in for frame series: ``events`` is a series per user or event type, ``lineitem`` rows of one order are
people in one frame, ``embeddings`` hold joints, ``documents`` and ``labels`` predictions and truth. Frames are row
numbers by time; every order has a tie-break that makes it unique. Floating-point results are rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelattice.functions import vec
from kinelattice.operators import align, cameras, detections, dyads, fusion, metrics, tables, temporal
from kinelattice.operators.results import Results, Summary, summarise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# results view -------------------------------------------------------------------------------------------------------


def _values(spark: SparkSession, sf_dir: str) -> Results:
    e = read(spark, sf_dir, "events")
    long = e.select(F.col("event_type").alias("metric_name"), F.date_format("ts", "yyyy-MM-dd").alias("sequence"), F.col("user_id").cast("string").alias("person"), "value")
    return Results.of(long)


_LONG = "(SELECT event_type AS metric_name, strftime(ts, '%Y-%m-%d') AS sequence, CAST(user_id AS VARCHAR) AS person, value FROM events)"


@query(f"""SELECT metric_name, person, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(median(value), 6) AS median, round(sum(value), 6) AS sum, CAST(count(value) AS BIGINT) AS count, CAST(count(DISTINCT value) AS BIGINT) AS nunique
FROM {_LONG} WHERE metric_name IN ('click', 'purchase') GROUP BY ALL""")
def results_query_agg(spark, sf_dir):
    view = _values(spark, sf_dir).query(metric_name=["click", "purchase"])
    out = view.aggregate(["metric_name", "person"], ["mean", "std", "min", "max", "median", "sum", "count", "nunique"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "median", "sum")})


_SUMMARY = """SELECT '{n}' AS summary, metric_name, {s} AS sequence, {p} AS person, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
FROM {t} WHERE metric_name IN ('click', 'view') {w} GROUP BY ALL"""
_PARTS = (("by_person", ("sequence",)), ("by_sequence", ("person",)), ("overall", ("sequence", "person")))


@query(" UNION ALL ".join(_SUMMARY.format(n=n, t=_LONG, w="", s="NULL" if "sequence" in d else "sequence", p="NULL" if "person" in d else "person") for n, d in _PARTS))
def results_summary(spark, sf_dir):
    results, out = _values(spark, sf_dir), None
    for name, dims in _PARTS:
        t = summarise(results, Summary(name, ("click", "view"), dims), check=False)
        t = t.select(F.lit(name).alias("summary"), "metric_name", *(F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in ("sequence", "person")), r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")
        out = t if out is None else out.unionByName(t)
    return out


@query("SELECT DISTINCT event_type AS metric_name FROM events")
def available_metrics(spark, sf_dir):
    return _values(spark, sf_dir).base.select("metric_name").distinct()


@query(f"SELECT metric_name, sequence, person, value FROM {_LONG} WHERE metric_name = 'click' AND person IN ('1', '2', '3') AND value IS NOT NULL")
def results_filter_dropna(spark, sf_dir):
    return _values(spark, sf_dir).query(metric_name="click", person=["1", "2", "3"]).to_dataframe(dropna=True)


@query(f"SELECT metric_name, sequence, person, value FROM {_LONG} WHERE value IS NOT NULL")
def results_dropna(spark, sf_dir):
    """The rows with a value, of the whole table."""
    return _values(spark, sf_dir).to_dataframe(dropna=True)


# temporal -----------------------------------------------------------------------------------------------------------


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a series: x = value, y = event_id, conf from the value, frame by time."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return e.select("user_id", "event_type", F.row_number().over(w).alias("frame"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"), (F.col("value") / 500).alias("conf"))


_S = "(SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame, value AS x, CAST(event_id AS DOUBLE) AS y, value / 500 AS conf FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY frame)"


@query(f"SELECT user_id, frame, round(x - lag(x) OVER w, 6) AS d_x, round(y - lag(y) OVER w, 6) AS d_y FROM {_S} {_W}")
def displacement(spark, sf_dir):
    out = temporal.displacement(_series(spark, sf_dir), ["user_id"], ["x", "y"])
    return out.select("user_id", "frame", r6("d_x").alias("d_x"), r6("d_y").alias("d_y"))


@query(f"""SELECT user_id, frame, round(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) * 30, 6) AS velocity,
 CASE WHEN lag(conf) OVER w IS NOT NULL THEN round(least(conf, lag(conf) OVER w), 6) END AS min_conf FROM {_S} {_W}""")
def velocity(spark, sf_dir):
    out = temporal.velocity(_series(spark, sf_dir), ["user_id"], ["x", "y"], 30.0, "conf")
    return out.select("user_id", "frame", r6("velocity").alias("velocity"), r6("min_conf").alias("min_conf"))


_LIMITS = [("click", 0.10), ("view", 0.15), ("purchase", 0.20)]
_LIMIT_SQL = "(VALUES ('click', 0.10), ('view', 0.15), ('purchase', 0.20)) AS l(event_type, lim)"
_JUMPS = f"""SELECT s.user_id, s.event_type, s.frame, CASE WHEN p IS NOT NULL THEN coalesce(abs(x - p) > lim * 1000, FALSE) END AS jump
FROM (SELECT *, lag(x) OVER (PARTITION BY user_id, event_type ORDER BY frame) AS p FROM {_S}) s LEFT JOIN {_LIMIT_SQL} ON s.event_type = l.event_type"""


def _jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(_LIMITS, "event_type string, diameter double")
    return temporal.jump_flags(_series(spark, sf_dir), ["user_id", "event_type"], ["x"], limits, "event_type", "diameter")


@query(_JUMPS)
def jump_flags(spark, sf_dir):
    return _jumps(spark, sf_dir).select("user_id", "event_type", "frame", "jump")


@query(f"SELECT user_id, event_type, CAST(count_if(jump) AS DOUBLE) AS jump_count FROM ({_JUMPS}) GROUP BY ALL")
def jump_count(spark, sf_dir):
    return metrics.jump_count(_jumps(spark, sf_dir), ["user_id", "event_type"])


@query(f"""SELECT user_id, frame, round(CASE WHEN n < 2 THEN NULL WHEN frame = 1 THEN b - x WHEN frame = n THEN x - a ELSE (b - a) / 2 END, 6) AS gradient
FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, count(*) OVER (PARTITION BY user_id) AS n FROM {_S} {_W})""")
def gradient(spark, sf_dir):
    return temporal.gradient(_series(spark, sf_dir), ["user_id"], "x").select("user_id", "frame", r6("gradient").alias("gradient"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"), "value")
    return e.groupBy("event_type", "frame").agg(F.sum("value").alias("x"))


_DAILY = "(SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame, sum(value) AS x FROM events GROUP BY ALL)"
_SG = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]


@query(f"""SELECT event_type, frame, round(smoothed, 6) AS smoothed FROM (SELECT event_type, frame, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n,
 ({" + ".join(f"({c}) * {'lag' if i < 5 else 'lead'}(x, {abs(i - 5)}) OVER w" for i, c in enumerate(_SG))}) / 429.0 AS smoothed
 FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY frame)) WHERE k > 5 AND k <= n - 5""")
def savgol_interior(spark, sf_dir):
    out = temporal.savgol(_daily(spark, sf_dir), ["event_type"], "x")
    w, all_ = Window.partitionBy("event_type").orderBy("frame"), Window.partitionBy("event_type")
    out = out.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(all_)}).filter("k > 5 and k <= n - 5")
    return out.select("event_type", "frame", r6("smoothed").alias("smoothed"))


_GAPS = f"(SELECT user_id, frame, CASE WHEN conf >= 0.06 OR conf IS NULL THEN x END AS x FROM {_S})"


@query(f"""SELECT user_id, frame, round(CASE WHEN x IS NOT NULL THEN x WHEN tb - ta <= 10 THEN xa + (xb - xa) * (frame - ta) / (tb - ta) END, 6) AS x FROM (
SELECT user_id, frame, x, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS ta, last_value(x IGNORE NULLS) OVER p AS xa,
 first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER f AS tb, first_value(x IGNORE NULLS) OVER f AS xb FROM {_GAPS}
WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def conf_mask_interp(spark, sf_dir):
    masked = temporal.mask_low_confidence(_series(spark, sf_dir), ["x"], "conf", 0.06)
    return temporal.interpolate(masked, ["user_id"], ["x"]).select("user_id", "frame", r6("x").alias("x"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations""")
def carry_forward(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return temporal.carry_forward(c, ["conv_id"], "text", F.col("role") != "assistant", "turn").select("conv_id", "turn", "carried")


@query(f"SELECT user_id, frame, round(frame / 30.0, 6) AS seconds, CAST(frame + 99 AS INT) AS real_frame FROM {_S} WHERE (frame - 1) % 5 = 0 AND frame >= 3 AND frame < 63")
def frame_times(spark, sf_dir):
    s = temporal.every_nth(_series(spark, sf_dir), 5, 1, "frame").filter(align.frame_range(3, 60))
    return s.select("user_id", "frame", r6(temporal.frame_time(F.col("frame"), 30.0)).alias("seconds"), temporal.real_frame(F.col("frame"), 100).alias("real_frame"))


@query(f"SELECT user_id, frame, round(frame / 30.0, 6) AS seconds, CAST(frame + 99 AS INT) AS real_frame FROM {_S}")
def frame_times_all(spark, sf_dir):
    """Times and real frame numbers of all frames."""
    return _series(spark, sf_dir).select("user_id", "frame", r6(temporal.frame_time(F.col("frame"), 30.0)).alias("seconds"), temporal.real_frame(F.col("frame"), 100).alias("real_frame"))


@query(f"SELECT user_id, frame, x FROM {_S} WHERE (frame - 1) % 5 = 0 AND frame >= 3")
def every_nth_open(spark, sf_dir):
    """Every fifth frame from the third on, without an upper bound."""
    return temporal.every_nth(_series(spark, sf_dir), 5, 1, "frame").filter(align.frame_range(3, -1)).select("user_id", "frame", "x")


# metrics and alignment ----------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"SELECT a.vec_id, round(list_distance(a.v, b.v), 6) AS jpe FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1")
def jpe(spark, sf_dir):
    pred = _vectors(spark, sf_dir)
    gt = pred.select((F.col("vec_id") - 1).alias("vec_id"), "v")
    return metrics.joint_error(align.align(pred, gt, ["vec_id"], how="inner")).select("vec_id", r6("jpe").alias("jpe"))


_BONES = [("upper", "j0", "j1"), ("lower", "j1", "j2"), ("span", "j0", "j3")]
_JOINT = {f"j{k}": (1 + 3 * k, 3 + 3 * k) for k in range(4)}
_BONE_SQL = " UNION ALL ".join(f"SELECT vec_id, label, '{b}' AS bone, list_distance(v[{_JOINT[x][0]}:{_JOINT[x][1]}], v[{_JOINT[y][0]}:{_JOINT[y][1]}]) AS bone_length FROM {_E}" for b, x, y in _BONES)


def _bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints = F.array(*(F.struct(F.lit(j).alias("joint"), F.slice("v", a, 3).alias("p")) for j, (a, _) in _JOINT.items()))
    points = _vectors(spark, sf_dir).select("vec_id", F.col("label").alias("person"), F.explode(joints).alias("e")).select("vec_id", "person", F.col("e.joint").alias("label"), F.col("e.p").alias("v"))
    return metrics.bone_lengths(points, ["vec_id", "person"], spark.createDataFrame(_BONES, "bone string, start string, end string"))


@query(f"SELECT vec_id, bone, round(bone_length, 6) AS bone_length FROM ({_BONE_SQL})")
def bone_length(spark, sf_dir):
    return _bone_lengths(spark, sf_dir).select("vec_id", "bone", r6("bone_length").alias("bone_length"))


@query(f"""SELECT label AS person, '3d' AS camera, 'mean_bone_length__' || bone AS metric, round(avg(bone_length), 6) AS value FROM ({_BONE_SQL}) GROUP BY label, bone
UNION ALL SELECT label, '3d', 'std_bone_length__' || bone, round(stddev_samp(bone_length), 6) FROM ({_BONE_SQL}) GROUP BY label, bone""")
def bone_summary(spark, sf_dir):
    out = metrics.bone_summary(_bone_lengths(spark, sf_dir), ["person"])
    return out.select("person", "camera", "metric", r6("value").alias("value"))


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return metrics.confusion(pairs, ["source", "lang"], F.col("toxic") != 0, F.col("quality") != 0)


_CONFUSION = """(SELECT source, lang, CAST(count_if(toxic <> 0 AND quality <> 0) AS BIGINT) AS tp, CAST(count_if(toxic = 0 AND quality = 0) AS BIGINT) AS tn,
 CAST(count_if(toxic <> 0 AND quality = 0) AS BIGINT) AS fp, CAST(count_if(toxic = 0 AND quality <> 0) AS BIGINT) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"""


@query(f"SELECT * FROM {_CONFUSION}")
def confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"""SELECT source, lang, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1
FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM {_CONFUSION})""")
def categorical_scores(spark, sf_dir):
    return _confusion(spark, sf_dir).select("source", "lang", *(r6(m()).alias(n) for n, m in metrics.CATEGORICAL.items()))


@query("SELECT doc_id, n_chars AS v_pred, CAST(quality AS DOUBLE) AS v_gt FROM documents LEFT JOIN labels USING (doc_id)")
def gt_left_join(spark, sf_dir):
    pred = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return align.align(pred, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("v")), ["doc_id"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END AS event_type FROM events")
def synonyms(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return align.rename_labels(e, spark.createDataFrame([("click", "tap"), ("unused", "x")], "old string, new string"), "event_type")


# pairs of people ----------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as people in a frame, left to right by a unique order."""
    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.withColumn("person", F.row_number().over(w))


_L = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS INT) AS person FROM lineitem)"


@query(f"""SELECT a.l_orderkey, a.person, round(sqrt((a.l_quantity - b.l_quantity) * (a.l_quantity - b.l_quantity) + (a.l_extendedprice - b.l_extendedprice) * (a.l_extendedprice - b.l_extendedprice)), 6) AS distance
FROM {_L} a JOIN {_L} b ON a.l_orderkey = b.l_orderkey AND a.person <> b.person WHERE a.l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 2)""")
def dyad_distance(spark, sf_dir):
    out = dyads.body_distance(_lines(spark, sf_dir), ["l_orderkey"], ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "person", r6("distance").alias("distance"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col
    return _lines(spark, sf_dir).select("l_orderkey", "person", q("l_quantity").alias("x1"), (q("l_discount") * 100).alias("y1"), (q("l_quantity") + 20).alias("x2"), (q("l_discount") * 100 + q("l_tax") * 100).alias("y2"))


_B = f"(SELECT l_orderkey, person, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 20 AS x2, l_discount * 100 + l_tax * 100 AS y2 FROM {_L})"
_IOU = f"""SELECT l_orderkey, person, other, round(i / nullif((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - i, 0), 6) AS iou FROM (
SELECT a.l_orderkey, a.person, b.person AS other, a.x1 ax1, a.x2 ax2, a.y1 ay1, a.y2 ay2, b.x1 bx1, b.x2 bx2, b.y1 by1, b.y2 by2,
 greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
FROM {_B} a JOIN {_B} b USING (l_orderkey))"""


@query(_IOU)
def iou_all_pairs(spark, sf_dir):
    out = dyads.box_overlaps(_boxed(spark, sf_dir), ["l_orderkey"])
    return out.select("l_orderkey", "person", "other", r6("iou").alias("iou"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 3).alias("p"), F.slice("v", 4, 3).alias("l"), F.slice("v", 7, 3).alias("d"))


_DOT = "({0}[1] * {1}[1] + {0}[2] * {1}[2] + {0}[3] * {1}[3])"
_P3 = f"(SELECT vec_id, v[1:3] AS p, v[4:6] AS l, v[7:9] AS d, [v[1] - v[4], v[2] - v[5], v[3] - v[6]] AS g, [v[4] - v[1], v[5] - v[2], v[6] - v[3]] AS ab, [v[7] - v[4], v[8] - v[5], v[9] - v[6]] AS bc FROM {_E})"


@query(f"SELECT vec_id, round(sqrt(greatest(0, (g[1] - d[1] * t) ** 2 + (g[2] - d[2] * t) ** 2 + (g[3] - d[3] * t) ** 2)), 6) AS distance FROM (SELECT *, {_DOT.format('d', 'g')} / nullif({_DOT.format('d', 'd')}, 0) AS t FROM {_P3})")
def point_line_distance(spark, sf_dir):
    return _slices(spark, sf_dir).select("vec_id", r6(vec.point_line_distance(F.col("p"), F.col("l"), F.col("d"))).alias("distance"))


@query(f"SELECT vec_id, round(degrees(acos(greatest(-1, least(1, {_DOT.format('ab', 'bc')} / nullif(sqrt({_DOT.format('ab', 'ab')}) * sqrt({_DOT.format('bc', 'bc')}), 0))))), 6) AS angle FROM {_P3}")
def body_angle(spark, sf_dir):
    return _slices(spark, sf_dir).select("vec_id", r6(vec.angle(F.col("p"), F.col("l"), F.col("d"))).alias("angle"))


@query(f"""SELECT vec_id, round(asin(-d[2] / n), 6) AS pitch, round(atan2(-d[1] / n, -d[3] / n), 6) AS yaw, CAST(trunc(-384.0 * sin(atan2(-d[1] / n, -d[3] / n)) * cos(asin(-d[2] / n))) AS INT) AS dx,
 CAST(trunc(-384.0 * sin(asin(-d[2] / n))) AS INT) AS dy FROM (SELECT *, sqrt({_DOT.format('d', 'd')}) AS n FROM {_P3})""")
def gaze_angles(spark, sf_dir):
    s = _slices(spark, sf_dir)
    pitch, yaw = vec.pitch_yaw(F.col("d"))
    dx, dy = vec.pixel_vector(pitch, yaw, F.lit(1920.0))
    return s.select("vec_id", r6(pitch).alias("pitch"), r6(yaw).alias("yaw"), dx.alias("dx"), dy.alias("dy"))


_DYAD = f"(SELECT vec_id // 2 AS frame, CAST(vec_id % 2 AS INT) AS person, v[1:3] AS head, v[4:6] AS dir FROM {_E})"
_GAP = "[b.head[1] - a.head[1], b.head[2] - a.head[2], b.head[3] - a.head[3]]"
_LOOK = f"""(SELECT frame, person, target, sqrt((g[1] - dir[1] * t) ** 2 + (g[2] - dir[2] * t) ** 2 + (g[3] - dir[3] * t) ** 2) AS distance FROM (
SELECT *, {_DOT.format('dir', 'g')} / nullif({_DOT.format('dir', 'dir')}, 0) AS t FROM (SELECT a.frame, a.person, b.person AS target, a.dir, {_GAP} AS g FROM {_DYAD} a JOIN {_DYAD} b ON a.frame = b.frame AND a.person <> b.person)))"""


@query(f"""SELECT x.frame, x.person, x.target, round(x.distance, 6) AS distance, coalesce(x.distance <= 1.5, FALSE) AS look_at, coalesce(x.distance <= 1.5, FALSE) AND coalesce(y.distance <= 1.5, FALSE) AS mutual
FROM {_LOOK} x JOIN {_LOOK} y ON x.frame = y.frame AND x.person = y.target AND x.target = y.person UNION ALL SELECT frame, person, person, 0.0, FALSE, FALSE FROM {_DYAD}""")
def gaze_contact(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("frame"), (F.col("vec_id") % 2).cast("int").alias("person"), "v")
    heads, gaze = v.select("frame", "person", F.slice("v", 1, 3).alias("head")), v.select("frame", "person", F.slice("v", 4, 3).alias("direction"))
    out = dyads.gaze_contact(heads, gaze, ["frame"], threshold=1.5)
    return out.withColumn("distance", r6("distance"))


_FUSED = "SELECT l_orderkey, round(x / nullif(n, 0), 6) AS x, round(y / nullif(n, 0), 6) AS y, round(z / nullif(n, 0), 6) AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ({}))"


def _fused(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", *(r6(F.element_at("fused", k + 1)).alias(c) for k, c in enumerate("xyz")))


@query(_FUSED.format("SELECT l_orderkey, avg(l_extendedprice) AS x, avg(l_discount) AS y, avg(l_tax) AS z FROM lineitem GROUP BY 1"))
def fuse_avg(spark, sf_dir):
    return _fused(fusion.fuse_mean(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_extendedprice", "l_discount", "l_tax"]))


@query(_FUSED.format("SELECT l_orderkey, " + ", ".join(f"sum({c} * l_quantity) / nullif(sum(l_quantity), 0) AS {n}" for c, n in (("l_extendedprice", "x"), ("l_discount", "y"), ("l_tax", "z"))) + " FROM lineitem GROUP BY 1"))
def fuse_weighted(spark, sf_dir):
    return _fused(fusion.fuse_weighted(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_extendedprice", "l_discount", "l_tax"], "l_quantity"))


# order, top-k, argmax -----------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_partkey, l_quantity, CAST(person - 1 AS INT) AS subject FROM {_L}")
def rank_subjects(spark, sf_dir):
    li = _lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity", "person")
    return detections.left_to_right(li, ["l_orderkey"], "l_partkey", "person").select("l_orderkey", "l_partkey", "l_quantity", "subject")


@query(f"""SELECT l_orderkey, person, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY person) - 1 AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, person) AS best, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {_L}) WHERE best <= 2 AND n >= 2""")
def topk_faces(spark, sf_dir):
    li = _lines(spark, sf_dir).select("l_orderkey", "person", "l_extendedprice")
    return detections.top_k(li, ["l_orderkey"], "l_extendedprice", 2, "person", all_or_none=True)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def worst_labels(spark, sf_dir):
    return detections.worst(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5, "p_partkey")


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1""")
def argmax_label(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("event_type")
    return fusion.argmax_label(n.withColumn("pos", F.row_number().over(w)), ["user_id"], "event_type", "n", "pos")


# table shapes -------------------------------------------------------------------------------------------------------

_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in _TYPES).replace("sum(", "round(sum(").replace(" END)", " END), 6)") + " FROM events GROUP BY 1")
def wide_export(spark, sf_dir):
    long = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    out = tables.wide_export(long, ["user_id"], "event_type", list(_TYPES))
    return out.select("user_id", *(r6(F.col(t)).alias(t) for t in _TYPES))


@query("""SELECT n_name, c_mktsegment, round(v, 6) AS value FROM (SELECT DISTINCT n_name FROM nation) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)
LEFT JOIN (SELECT n_name, c_mktsegment, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) USING (n_name, c_mktsegment)""")
def gridding(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    values = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(r6(F.avg("c_acctbal")).alias("value"))
    return tables.dense_grid(values, {"n_name": nation, "c_mktsegment": customer})


_ALTERED = "(SELECT o_orderkey + CASE WHEN o_orderkey % 1000 = 7 THEN 100000000 ELSE 0 END AS o_orderkey, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE 0 END AS v FROM orders)"


@query(f"""SELECT round(max(abs(a.o_totalprice - b.v)), 6) AS max_abs, round(avg(abs(a.o_totalprice - b.v)), 6) AS mean_abs, round(stddev_pop(a.o_totalprice - b.v), 6) AS std_diff,
 CAST(count_if(abs(a.o_totalprice - b.v) > 1e-8 + 1e-5 * abs(b.v)) AS BIGINT) AS different, CAST(count_if(b.o_orderkey IS NULL) AS BIGINT) AS only_ours, CAST(count_if(a.o_orderkey IS NULL) AS BIGINT) AS only_golden
FROM orders a FULL OUTER JOIN {_ALTERED} b ON a.o_orderkey = b.o_orderkey""")
def regression_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    k = F.col("o_orderkey")
    altered = o.select((k + F.when(k % 1000 == 7, 100000000).otherwise(0)).alias("o_orderkey"), (F.col("v") + F.when(k % 10 == 0, 0.5).otherwise(0.0)).alias("v"))
    out = tables.regression_diff(o, altered, ["o_orderkey"], "v")
    return out.withColumns({c: r6(c) for c in ("max_abs", "mean_abs", "std_diff")})


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS BIGINT) AS zero FROM embeddings")
def zero_vectors(spark, sf_dir):
    return tables.zero_vectors(read(spark, sf_dir, "embeddings"), "embedding")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)")
def drop_last(spark, sf_dir):
    return tables.drop_last(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query(f"""SELECT event_type, frame, 'part_' || CAST(user_id % 3 AS VARCHAR) AS bodypart, round(avg(x), 6) AS x FROM {_S} WHERE user_id % 4 <> 3 GROUP BY ALL""".replace("'part_' || CAST(user_id % 3 AS VARCHAR)", "CASE user_id % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'arm' ELSE 'leg' END"))
def bodypart_means(spark, sf_dir):
    parts = spark.createDataFrame([("arm", 0), ("arm", 1), ("leg", 2)], "bodypart string, joint long")
    s = _series(spark, sf_dir).withColumn("joint", F.col("user_id") % 4)
    return fusion.bodypart_means(s, ["event_type", "frame"], "x", parts, "joint").withColumn("x", r6("x"))


@query(f"SELECT event_type, frame, CASE WHEN user_id % 4 < 2 THEN 'arm' ELSE 'leg' END AS bodypart, round(avg(x), 6) AS x FROM {_S} GROUP BY ALL")
def bodypart_means_all(spark, sf_dir):
    """As bodypart_means, with a body part for each joint."""
    parts = spark.createDataFrame([("arm", 0), ("arm", 1), ("leg", 2), ("leg", 3)], "bodypart string, joint long")
    s = _series(spark, sf_dir).withColumn("joint", F.col("user_id") % 4)
    return fusion.bodypart_means(s, ["event_type", "frame"], "x", parts, "joint").withColumn("x", r6("x"))


@query(f"SELECT vec_id, round(v[1], 4) AS x, round(v[2], 4) AS y, round(v[3], 4) AS z, 0.9::DOUBLE AS conf FROM {_E}")
def triangulated(spark, sf_dir):
    """Points of ``embeddings`` seen by two cameras and brought back to 3-D."""
    one = {"K": [[800.0, 0, 320], [0, 800, 240], [0, 0, 1]], "r": [0.0, 0, 0], "t": [0.0, 0, 10]}
    two = {"K": [[800.0, 0, 320], [0, 800, 240], [0, 0, 1]], "r": [0.0, 0.4, 0], "t": [-3.0, 0, 11]}
    seen = None
    for name, camera in (("c1", one), ("c2", two)):
        m = cameras.complete(camera)["P"].tolist()
        h = vec.matvec(F.array(*(F.array(*(F.lit(x) for x in row)) for row in m)), F.concat(F.slice("v", 1, 3), F.array(F.lit(1.0))))
        own = _vectors(spark, sf_dir).select("vec_id", F.lit(name).alias("camera"), h.alias("h"))
        own = own.select("vec_id", "camera", *(F.try_divide(F.element_at("h", k), F.element_at("h", 3)).alias(c) for k, c in ((1, "x"), (2, "y"))), F.lit(0.9).alias("conf"))
        seen = own if seen is None else seen.unionByName(own)
    out = cameras.triangulate_joints(seen, one, two, ("c1", "c2"), ["vec_id"])
    return out.select("vec_id", *(F.round(c, 4).alias(c) for c in "xyz"), "conf")
