"""Every query with SQL, Spark against DuckDB on the smallest input; the import without
the subpackage of training-data operators."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from weftline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    return Counter(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    if name in plans.ORACLE_SQL:
        expected = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got)


def test_entry_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "weftline").mkdir()
    for p in (root / "weftline").iterdir():
        if p.name != "llm":
            (tmp_path / "weftline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'golden_person' in e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
