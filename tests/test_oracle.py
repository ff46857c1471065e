"""Every query runs on the smallest folder, and equals its SQL where there is one."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    whole = df[sorted(df.columns)].astype(object)
    for c in whole.columns:
        if pd.api.types.is_float_dtype(df[c]) and (df[c].dropna() % 1 == 0).all():
            whole[c] = [None if v != v else int(v) for v in df[c]]
    return sorted(tuple(map(cell, r)) for r in whole.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    if name not in entry.oracle_sql():  # no SQL: there are rows, and they do not depend on how they are dealt out
        rows = plain(got.toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            assert rows and plain(entry.queries()[name](spark, FOLDER).toPandas()) == rows
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return
    want = duck.sql(entry.oracle_sql()[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 7
