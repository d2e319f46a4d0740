"""Jump counts of short and odd series equal their SQL: single frames, no times, values that are no numbers."""

from datetime import datetime, timedelta

import duckdb
import pytest

from kinelattice.plans import catalog, runs  # noqa: F401, the queries of runs are registered with the catalog's

_START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """User 1 has one click, user 2 one view and many errors without a limit, user 3 clicks without a time."""
    nan, inf = float("nan"), float("inf")
    values = [(1, "click", 5.0), (2, "view", 7.0), *((2, "error", v) for v in (1.0, nan, 3.0, inf, inf, 400.0)), *((3, "click", v) for v in (0.0, 300.0, 20.0, nan, 25.0, 180.0))]
    rows = [(k, None if u == 3 and k % 3 == 1 else _START + timedelta(minutes=k), u, e, v, "") for k, (u, e, v) in enumerate(values)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def both(spark, sf: str, name: str) -> tuple[list, list]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    return sorted(map(str, map(tuple, catalog.QUERIES[name](spark, sf).collect()))), sorted(map(str, con.execute(catalog.ORACLES[name]).fetchall()))


@pytest.mark.parametrize("name", ["jump_flags", "jump_count", "jump_states"])
def test_odd_series_equal_sql(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want
    if name != "jump_flags":
        assert "(1, 'click', None)" in got and "(2, 'view', None)" in got and "(2, 'error', 0.0)" in got
