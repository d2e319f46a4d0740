"""Session helpers shared by the operators: worker imports and shared intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Make the session fit for functions that read whole texts in Python workers.

    Workers import this package where the driver runs it from a source tree: a cluster deployment ships the package
    (``--py-files`` or an installed wheel); in local mode the workers only inherit PYTHONPATH, so the source root is
    added for functions made from now on. Arrow batches are held to 16 MB where the session has Spark's default of 64.
    """
    if spark.conf.get(_BATCH_BYTES, None) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "16m")
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    if _ROOT not in os.pathsep.join(paths).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths[:1]])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="kinelattice-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that :func:`cut` returned, once nothing reads it any more."""
    path = getattr(df, "_kl_path", None)
    if path and _written.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, for files of one's own; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/kinelattice/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files.

    Unlike a cache, the table survives the loss of executors. Tables that are left go when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kl_path = path
    return out


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
