"""From raw detections to subjects: confidence filter, overlap suppression, left-to-right order, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.operators import temporal


def confident(df: DataFrame, score: str = "score", above: float = 0.7) -> DataFrame:
    return df.filter(F.col(score) > above)


def left_to_right(df: DataFrame, keys: list[str], x: str = "x1", tie: str = "pos") -> DataFrame:
    """Adds subject: 0 for the leftmost detection of a frame."""
    return df.withColumn("subject", F.row_number().over(Window.partitionBy(*keys).orderBy(x, tie)) - 1)


def assign_visible(df: DataFrame, keys: list[str], visibility: DataFrame, x: str = "x1", tie: str = "pos", fallback: int | None = None) -> DataFrame:
    """Adds subject: the rank-th subject that the camera sees (``visibility``: camera, rank, subject_pos).

    More detections than visible subjects are dropped, or, with ``fallback`` subjects, keep their rank if it is below.
    """
    ranked = left_to_right(df, keys, x, tie).withColumnRenamed("subject", "rank")
    joined = ranked.join(visibility, ["camera", "rank"], "left" if fallback is not None else "inner")
    own = F.coalesce("subject_pos", "rank") if fallback is not None else F.col("subject_pos")
    out = joined.withColumn("subject", own).drop("subject_pos", "rank")
    return out.filter(F.col("subject") < fallback) if fallback is not None else out


def visible_only(df: DataFrame, visibility: DataFrame) -> DataFrame:
    """Rows of subjects that their camera sees."""
    return df.join(visibility.select("camera", F.col("subject_pos").alias("subject")), ["camera", "subject"], "left_semi")


def top_k(df: DataFrame, keys: list[str], score: str, k: int, pos: str = "pos", all_or_none: bool = False) -> DataFrame:
    """The k best rows of each group in their original order (rank from 0); groups with fewer rows are left out if asked."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), pos))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumns({"_best": best, "_n": n}).filter(F.col("_best") <= k)
    out = out.filter(F.col("_n") >= k) if all_or_none else out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1).drop("_best", "_n")


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with corners in order; NULL for two empty boxes."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    tall = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return F.try_divide(wide * tall, area(a) + area(b) - wide * tall)


def without_overlaps(boxes: Column, threshold: float = 0.9) -> Column:
    """The boxes (an array of structs with x1, y1, x2, y2, score) left when the lower-scored box of each pair with a larger overlap goes.

    A fold over the overlapping pairs in order; its state is the places of the boxes that went, which take no further part.
    Of equal scores the first one goes. Each pair is compared once, as two variables; what the fold sees is the few that overlap.
    """

    def overlapping(a: Column, i: Column) -> Column:
        """The later boxes that box i overlaps: i, j and which of them goes."""
        later = F.transform(boxes, lambda b, j: F.when((i < j) & (_overlap(a, b) > threshold), F.struct(i.alias("i"), j.alias("j"), F.when(b["score"] < a["score"], j).otherwise(i).alias("lose"))))
        return F.filter(later, lambda x: x.isNotNull())

    def step(gone: Column, x: Column) -> Column:
        return F.when(~F.array_contains(gone, x["i"]) & ~F.array_contains(gone, x["j"]), F.array_append(gone, x["lose"])).otherwise(gone)

    gone = F.aggregate(F.flatten(F.transform(boxes, overlapping)), F.array().cast("array<int>"), step)
    left = F.transform(F.array(gone), lambda g: F.filter(boxes, lambda x, k: ~F.array_contains(g, k)))  # one fold, not one per box
    return F.element_at(left, 1)


_BOX = ("x1", "y1", "x2", "y2", "score")


def suppress_overlaps(df: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """Greedy suppression within a camera and frame, in order of ``pos``: a frame's few boxes meet in one array."""
    frames = df.groupBy(*keys).agg(F.collect_list(F.struct(*df.columns)).alias("boxes"))
    ordered = F.array_sort("boxes", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    left = frames.select(ordered.alias("boxes")).select(F.explode(without_overlaps(F.col("boxes"), threshold)).alias("b"))
    return left.select(*(F.col(f"b.`{c}`").alias(c) for c in df.columns))


def correct_people(df: DataFrame, keys: list[str], frame: str, n_subjects: int, above: float = 0.7, threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """keys, frame, people: the detections of each frame, left to right.

    Confident boxes; where their number is wrong, overlaps are suppressed; where it is still wrong, the last accepted
    frame of the series stands in (empty at the start). Frames without detections need a row in ``df`` with NULL pos. One
    aggregation by frame and one scan of the series, over blocks of it if asked for.
    """
    sure = F.when((F.col("score") > above) & F.col("pos").isNotNull(), F.struct("pos", *_BOX))
    frames = df.groupBy(*keys, frame).agg(F.array_sort(F.collect_list(sure)).alias("boxes"))
    enough = F.size("boxes") == n_subjects
    frames = frames.withColumn("boxes", F.when(enough, F.col("boxes")).otherwise(without_overlaps(F.col("boxes"), threshold)))
    people = F.array_sort(F.transform("boxes", lambda b: F.struct(b["x1"].alias("x1"), b["pos"].alias("pos"), *(b[c].alias(c) for c in ("y1", "x2", "y2", "score")))))
    found = frames.select(*keys, frame, people.alias("people"))
    out = temporal.carry_forward(found, keys, "people", F.size("people") == n_subjects, frame, block)
    return out.select(*keys, frame, F.coalesce("carried", F.array().cast(dict(found.dtypes)["people"])).alias("people"))


def worst(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest value (a top-k report)."""
    return df.orderBy(F.col(value).desc(), *ties).limit(k)
