"""Queries of the training-data operators against their oracles at the smallest size."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
from compare import rows  # noqa: E402

from quantora.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small_data):
    got = QUERIES[name](spark, small_data).toPandas()
    assert len(got.columns)
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in ORACLES:
        c = duckdb.connect()
        for p in Path(small_data).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        assert rows(got) == rows(c.execute(ORACLES[name]).df())
