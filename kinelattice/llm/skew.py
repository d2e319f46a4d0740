"""Joins from many rows to the groups that they belong to, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from this part of all rows on, so there are fewer than so many hot groups, whatever the data.
PARTS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """The inner (or ``how="left"``) join of ``rows`` with ``groups`` (one row for each ``on``; ``weight``: how many of ``rows`` it matches).

    ``total`` is the sum of all weights, by default the number of rows. Groups with more than a ``PARTS``-th of all rows are fewer than ``PARTS``: they are broadcast and their rows are not
    shuffled. All others meet by hash, so no task gets a hot group. Both sides should be written tables.
    """
    total = rows.count() if total is None else total
    is_hot = F.col(weight) * PARTS > total
    hot = F.broadcast(groups.filter(is_hot))
    rest = rows.join(F.broadcast(groups.filter(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(groups.filter(~is_hot), on, how))
