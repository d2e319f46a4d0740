"""Every registered query with SQL gives the rows that DuckDB gives."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from kinelattice.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NA:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        return round(float(x), 5) if hasattr(x, "__float__") and not isinstance(x, str) else x

    return sorted(str([cell(x) for x in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_dropna_covers_the_whole_table(spark, sf, duck):
    assert catalog.QUERIES["results_dropna"](spark, sf).count() == duck.execute("SELECT count(value) FROM events").fetchone()[0]


def test_frame_times_cover_all_frames(spark, sf, duck):
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert catalog.QUERIES["frame_times_all"](spark, sf).count() == n
    assert catalog.QUERIES["every_nth_open"](spark, sf).filter("frame >= 63").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_folders(tmp_path):
    """A copy without the training-data folder registers the other queries, whether corpus_pipeline.py is there or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/kinelattice", tmp_path / "kinelattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "kinelattice" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("from kinelattice.llm import exact_dedup\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) == len(catalog.QUERIES)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
