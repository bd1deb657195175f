"""Every registered query runs; those with an oracle equal it in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from nightledger import plans
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return f"{float(v):.9g}"
        return str(v)

    return list(df.columns), sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, duck):
    got = plans.queries()[name](spark, SMALL).toPandas()
    sql = plans.oracles().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want_cols, want = canonical(duck.execute(sql).df())
    cols, rows = canonical(got)
    assert cols == want_cols
    as_number = {"True": "1", "False": "0"}
    norm = lambda rs: [tuple(as_number.get(c, c[:-2] if c.endswith(".0") else c) for c in r) for r in rs]
    assert norm(rows) == norm(want)


def test_names_match():
    assert set(plans.oracles()) <= set(plans.queries())
