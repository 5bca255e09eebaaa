"""Every core query agrees with its oracle at the smallest size, and the entry point keeps its contract."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import rows  # noqa: E402

from quantora.plans.catalogue import gather  # noqa: E402

QUERIES, ORACLES = gather()


@pytest.fixture(scope="module")
def con(small_data):
    c = duckdb.connect()
    for p in Path(small_data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small_data, con):
    got = QUERIES[name](spark, small_data).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
