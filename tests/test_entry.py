"""The registry, and each query's SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from rallyframe.plans import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="generated tables aren't here")


def normal(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None or v is pd.NaT or v != v else round(float(v), 6) + 0.0 if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


def test_registry():
    assert set(ORACLE) <= set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@needs_data
def test_entry(spark):
    assert entry_point.entry(spark).count() == 4


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, wanted = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert normal(got) == normal(wanted)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_twin(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
