"""Frame ranges, image paths and video properties as DataFrames. Decoding video stays outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_length(start: int, length: int, available: int) -> int:
    """Frames to use: -1 means all from ``start``."""
    if start < 0 or start >= available:
        raise ValueError(f"start {start} is outside of {available} frames")
    return available - start if length == -1 else length


def resolve_format(**given: bool) -> str:
    """The one input format that is there; none or several are an error."""
    found = [k for k, v in given.items() if v]
    if len(found) != 1:
        raise ValueError(f"exactly one input format is needed, found {found}")
    return found[0]


def image_paths(spark: SparkSession, cameras: list[str], known: list[str], start: int, stop: int, pattern: str, step: int = 1) -> DataFrame:
    """(frame, frame_idx, camera, path): the path that each camera's image should have.

    ``pattern`` is a printf format of camera and frame. Unknown cameras are a ValueError.
    """
    if wrong := set(cameras) - set(known):
        raise ValueError(f"unknown cameras {sorted(wrong)}")
    frames = spark.range(start, stop, step).select(F.col("id").cast("int").alias("frame"), ((F.col("id") - start) / step).cast("int").alias("frame_idx"))
    return frames.select("*", F.explode(F.array(*(F.lit(c) for c in cameras))).alias("camera")).withColumn("path", F.format_string(pattern, "camera", "frame"))


def listing(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path) of the files below a folder with a suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths`` with NULL where the file is missing: rows stay, so frames never shift."""
    there = files.select("path", F.lit(True).alias("_there"))
    return paths.join(there, "path", "left").withColumn("path", F.when(F.col("_there"), F.col("path"))).drop("_there")


def by_frame(paths: DataFrame) -> DataFrame:
    """(frame_idx, frame, images): one row per frame, path by camera."""
    return paths.groupBy("frame_idx", "frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera", "path")))).alias("images"))


def by_camera(paths: DataFrame) -> DataFrame:
    return paths.groupBy("camera").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "path"))), lambda x: x["path"]).alias("images"))


def batches(paths: DataFrame, size: int) -> DataFrame:
    """(batch, frames): rows of ``by_frame`` in batches of ``size`` frames."""
    if not isinstance(size, int) or size <= 0:
        raise ValueError("the batch size must be a positive integer")
    frames = by_frame(paths).withColumn("batch", F.floor(F.col("frame_idx") / size).cast("int"))
    return frames.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "frame", F.map_entries("images").alias("images")))).alias("frames"))


def rows_by_path(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Detector rows (path and others) with the frame and camera of their image; rows of unknown paths go."""
    return rows.join(paths.select("path", "frame", "frame_idx", "camera"), "path")


def integer_fps(fps: Column) -> Column:
    """Frames per second cut to an integer, -1 where they are unknown."""
    return F.coalesce(fps.cast("int"), F.lit(-1))


def real_frames(images: DataFrame, start: int, expected: int, n: str = "n") -> DataFrame:
    """Adds frame: the n-th extracted image, from 1, is frame ``start`` + n - 1. AssertionError unless all are there."""
    found = images.select(F.count_distinct(n), F.min(n), F.max(n)).first()
    if tuple(found) != (expected, 1, expected):
        raise AssertionError(f"{expected} frames were expected; found {found[0]}, numbered {found[1]} to {found[2]}")
    return images.withColumn("frame", F.col(n) + F.lit(start - 1))


def fraction(rate: Column) -> Column:
    """A rational like "30000/1001"; NULL for a zero denominator."""
    parts = F.split(rate, "/")
    return F.try_divide(F.element_at(parts, 1).cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(1.0)))


_PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,avg_frame_rate:string,nb_frames:string,width:int,height:int,duration:string>>,format:struct<duration:string>>"


def video_properties(probes: DataFrame, text: str = "probe") -> DataFrame:
    """Adds codec, fps, n_frames, width, height, duration from a prober's JSON; the container's duration stands in."""
    got = F.from_json(F.col(text), _PROBE)
    video = F.get(F.filter(got["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    fps = fraction(video["avg_frame_rate"])
    duration = F.coalesce(video["duration"].try_cast("double"), got["format"]["duration"].try_cast("double"))
    frames = F.coalesce(video["nb_frames"].try_cast("bigint"), (fps * duration).cast("bigint"))
    return probes.withColumns({"codec": video["codec_name"], "fps": fps, "n_frames": frames, "width": video["width"], "height": video["height"], "duration": duration})
