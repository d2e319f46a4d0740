"""The results view: filter, aggregate, summarise and export long metric values.

A view is immutable and lazy: every call returns a new view over one Spark plan, so filters and column pruning reach
the Parquet scan.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelattice.operators.quantiles import exact_quantiles

LEVELS = ("metric_name", "dataset", "session", "sequence", "component", "algorithm", "metric_type", "person", "camera", "label", "frame")
#: Dimensions that a configured summary may aggregate over.
AGGREGABLE = frozenset({"sequence", "person", "camera", "label", "frame"})
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "median": F.median,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "count": F.count, "nunique": F.count_distinct, "prod": F.product,
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    "sem": lambda c: F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c))),
}


@dataclass(frozen=True)
class Results:
    """``base`` holds all values, ``view`` those that the filters so far kept; NaN became NULL on the way in."""

    base: DataFrame
    view: DataFrame
    levels: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, levels: tuple[str, ...] | None = None) -> Results:
        value = F.col("value")
        clean = df.withColumn("value", F.when(~F.isnan(value), value)) if dict(df.dtypes)["value"] in ("float", "double") else df
        return cls(clean, clean, levels or tuple(c for c in LEVELS if c in df.columns))

    def query(self, strict: bool = False, **filters) -> Results:
        """Rows where each level has the value, or one of the values, given.

        Unknown levels raise KeyError. With ``strict``, so do values that the view lacks and combinations without rows
        (one pass over the filtered columns); an empty list gives an empty view.
        """
        if missing := [k for k in filters if k not in self.levels]:
            raise KeyError(f"unknown levels {missing}; there are {list(self.levels)}")
        if not filters:
            return self
        wanted = {k: list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v] for k, v in filters.items()}
        keep = None
        for k, values in wanted.items():
            own = F.col(k).isin(*values) if values else F.lit(False)
            keep = own if keep is None else keep & own
        if strict and all(wanted.values()):
            checks = [(k, v) for k, values in wanted.items() for v in values]
            row = self.view.agg(F.count_if(keep).alias("all"), *(F.count_if(F.col(k) == v).alias(f"c{i}") for i, (k, v) in enumerate(checks))).first()
            if absent := [c for i, c in enumerate(checks) if not row[f"c{i}"]]:
                raise KeyError(f"values not found: {absent}")
            if not row["all"]:
                raise KeyError(f"no rows match {wanted}")
        return Results(self.base, self.view.filter(keep), self.levels)

    def reset(self) -> Results:
        return Results(self.base, self.base, self.levels)

    def aggregate(self, group_by: str | list[str], agg_funcs: str | list[str] = "mean", ordered: bool = True) -> DataFrame:
        """Grouped values: one function gives column ``value``, a list one column per function."""
        groups = [group_by] if isinstance(group_by, str) else list(group_by)
        if missing := [g for g in groups if g not in self.levels]:
            raise KeyError(f"unknown levels {missing}; there are {list(self.levels)}")
        names = [agg_funcs] if isinstance(agg_funcs, str) else list(agg_funcs)
        if wrong := [n for n in names if n not in AGGREGATES]:
            raise ValueError(f"unknown aggregates {wrong}; there are {sorted(AGGREGATES)}")
        single = isinstance(agg_funcs, str)
        out = self.view.groupBy(*groups).agg(*(AGGREGATES[n]("value").alias("value" if single else n) for n in names))
        return out.orderBy(*groups) if ordered else out

    def quantiles(self, group_by: str | list[str], q: tuple[float, ...] = (0.5,)) -> DataFrame:
        """groups, q, quantile: exact, in bounded memory for groups of any size; the median in ``aggregate`` holds a group's values."""
        groups = [group_by] if isinstance(group_by, str) else list(group_by)
        if missing := [g for g in groups if g not in self.levels]:
            raise KeyError(f"unknown levels {missing}; there are {list(self.levels)}")
        return exact_quantiles(self.view, groups, "value", q)

    @property
    def available_metrics(self) -> list[str]:
        return [r[0] for r in self.base.select("metric_name").distinct().orderBy("metric_name").collect()]

    def to_dataframe(self, dropna: bool = False) -> DataFrame:
        return self.view.na.drop("any") if dropna else self.view

    def to_csv(self, output_dir: str, file_name: str = "summary", single: bool = False) -> str:
        """Write the view as CSV and return the path: a folder written by the tasks or, if asked for, one file."""
        return str(write_small_csv(self.view, output_dir, file_name)) if single else write_csv(self.view, output_dir, file_name)


def write_csv(df: DataFrame, output_dir: str, file_name: str) -> str:
    """A CSV folder ``<output_dir>/<file_name>.csv`` written by the tasks; returns its path."""
    path = f"{output_dir.rstrip('/')}/{file_name}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_small_csv(df: DataFrame, output_dir: str, file_name: str, most: int = 1_000_000) -> Path:
    """One CSV file from a summary of at most ``most`` rows; larger ones are an error, not cut."""
    path = Path(output_dir) / f"{file_name}.csv"
    os.makedirs(output_dir, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for k, row in enumerate(df.toLocalIterator()):
            if k == most:
                raise ValueError(f"more than {most} rows; use write_csv")
            out.writerow(row)
    return path


@dataclass(frozen=True)
class Summary:
    """A configured summary. ``filters`` may hold metric_name: both conditions then apply."""

    name: str
    metric_names: tuple[str, ...]
    aggregate_dims: tuple[str, ...]
    agg_funcs: tuple[str, ...] = ("mean", "std", "min", "max")
    filters: tuple[tuple[str, tuple], ...] = ()

    def __post_init__(self):
        if wrong := set(self.aggregate_dims) - AGGREGABLE:
            raise ValueError(f"cannot aggregate over {sorted(wrong)}; allowed are {sorted(AGGREGABLE)}")


def summarise(results: Results, summary: Summary, check: bool = True) -> DataFrame | None:
    """The summary's table, or None if one of its metrics is absent."""
    if check and set(summary.metric_names) - set(results.available_metrics):
        return None
    view = results.reset().query(metric_name=list(summary.metric_names))
    for k, values in summary.filters:
        view = view.query(**{k: list(values)})
    groups = [k for k in results.levels if k not in summary.aggregate_dims]
    return view.aggregate(groups, list(summary.agg_funcs))


def create_summaries(results: Results, summaries: list[Summary], output_dir: str, single: bool = False) -> dict[str, str | None]:
    """Write every summary, as a folder or as one file; the path by name, None for those skipped."""
    out = {}
    for s in summaries:
        table = summarise(results, s)
        out[s.name] = None if table is None else str(write_small_csv(table, output_dir, s.name)) if single else write_csv(table, output_dir, s.name)
    return out


def write_metric_summaries(summary: DataFrame, output_dir: str, dataset: str, single: bool = False) -> list[str]:
    """One CSV ``<dataset>_<metric_type>_summary.csv``, a folder or, with ``single``, a file, per metric type of (metric_type, metric, ..., value) rows."""
    types = [r[0] for r in summary.select("metric_type").distinct().orderBy("metric_type").collect()]
    write = (lambda *a: str(write_small_csv(*a))) if single else write_csv
    return [write(summary.filter(F.col("metric_type") == t), output_dir, f"{dataset}_{t}_summary") for t in types]
