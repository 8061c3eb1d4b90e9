"""Every query with SQL against DuckDB over the same files."""

import os

import duckdb
import pandas as pd
import pytest

from lodestrata.queries import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
