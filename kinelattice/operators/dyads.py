"""Operators on pairs of people in one camera and frame: distances, gaze contact, box overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.functions.vec import box_iou, distance, point_line_distance, strict_mean, strict_mean_of


def pairs(df: DataFrame, keys: list[str], member: str, columns: list[str], include_self: bool = False, only_dyads: bool = False) -> DataFrame:
    """Every ordered pair of members of a group: keys, <member>_a, <member>_b, <column>_a, <column>_b.

    The few people of a frame meet once, in an array, and pairs are expanded from it. Groups with a NULL key have no pairs;
    ``only_dyads`` keeps groups of exactly two.
    """
    known = reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in keys))
    groups = df.filter(known).groupBy(*keys).agg(F.collect_list(F.struct(member, *columns)).alias("_all"))
    groups = groups.filter(F.size("_all") == 2) if only_dyads else groups
    both = groups.select(*keys, "_all", F.explode("_all").alias("_a")).select(*keys, "_a", F.explode("_all").alias("_b"))
    out = both.select(*keys, *(F.col(f"_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in (member, *columns)))
    return out if include_self else out.filter(F.col(f"{member}_a") != F.col(f"{member}_b"))


def mean_point(points: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """Mean of the selected keypoints; missing if one of them is."""
    return points.groupBy(*keys).agg(F.array(*(strict_mean(F.col(c)) for c in coords)).alias("centre"))


def body_distance(points: DataFrame, keys: list[str], coords: list[str], person: str = "person") -> DataFrame:
    """keys, person, distance between the two people's mean keypoints; the same value for both. Coordinates only.

    Windows over a frame find the frames of two people; only those are aggregated, both people in one row. Frames with a
    NULL key or person have no distance.
    """
    frame, p = Window.partitionBy(*keys), F.col(person)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    ends = points.filter(known).select(*keys, person, *coords).withColumns({"_a": F.min(p).over(frame), "_b": F.max(p).over(frame)})
    third = F.coalesce((p != F.col("_a")) & (p != F.col("_b")), F.lit(True))
    dyads = ends.withColumn("_more", F.max(third).over(frame)).filter(~F.col("_more") & (F.col("_a") != F.col("_b")))
    centre = lambda who: F.array(*(strict_mean_of(F.col(c), p == F.col(who)) for c in coords))
    both = dyads.groupBy(*keys, "_a", "_b").agg(distance(centre("_a"), centre("_b")).alias("distance"))
    return both.select(*keys, F.explode(F.array("_a", "_b")).alias(person), "distance")


def gaze_contact(heads: DataFrame, gaze: DataFrame, keys: list[str], person: str = "person", threshold: float = 0.4) -> DataFrame:
    """keys, person, target, distance, look_at, mutual for every ordered pair, self included (0 and false).

    ``heads`` has the face centre (head), ``gaze`` the direction (direction). The gaze is an infinite line.
    """
    both = pairs(heads.join(gaze, [*keys, person]), keys, person, ["head", "direction"], include_self=True)
    there = point_line_distance(F.col("head_b"), F.col("head_a"), F.col("direction_a"))
    back = point_line_distance(F.col("head_a"), F.col("head_b"), F.col("direction_b"))
    hits = lambda c: F.coalesce(F.col(c) <= threshold, F.lit(False))
    own = F.col(f"{person}_a") == F.col(f"{person}_b")
    seen = both.select(*keys, F.col(f"{person}_a").alias(person), F.col(f"{person}_b").alias("target"), own.alias("_own"), F.when(own, 0.0).otherwise(there).alias("distance"), back.alias("_back"))
    return seen.select(*keys, person, "target", "distance", (~F.col("_own") & hits("distance")).alias("look_at"), (~F.col("_own") & hits("distance") & hits("_back")).alias("mutual"))


def box_overlaps(boxes: DataFrame, keys: list[str], person: str = "person", corners: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """keys, person, other, iou for all pairs, self included."""
    both = pairs(boxes, keys, person, list(corners), include_self=True)
    side = lambda s: [F.col(f"{c}_{s}") for c in corners]
    return both.select(*keys, F.col(f"{person}_a").alias(person), F.col(f"{person}_b").alias("other"), box_iou(side("a"), side("b")).alias("iou"))


def other_person(person: Column, first: Column, second: Column) -> Column:
    """The other one of a dyad."""
    return F.when(person == first, second).when(person == second, first)


def proximity_bar(x1: Column, y1: Column, x2: Column, y2: Column, d: Column, lift: float) -> dict[str, Column]:
    """End points of a bar of length ``d`` above the middle of two points, ``lift`` away."""
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2 - lift
    return {"bar_x1": mx - d / 2, "bar_y1": my, "bar_x2": mx + d / 2, "bar_y2": my}
