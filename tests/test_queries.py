import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("~" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(core.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(core.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
