"""Every query with oracle SQL gives the oracle's rows on the smallest tables; the others run and keep their invariants."""

import os

import duckdb
import pandas as pd
import pytest

from curatrix.plans import condensation, curation, incremental, normalization

SF = "/root/testdata/sf0.001"
PLANS = (curation, normalization, condensation, incremental)
CASES = [(p, k) for p in PLANS for k in p.SQL]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def table(df):
    df = df[sorted(df.columns)]
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731  nulls make pandas turn integers into floats
    rows = [tuple("" if pd.isna(x) else str(round(x, 6)) if isinstance(x, float) else str(x) for x in map(whole, r)) for r in df.astype(object).itertuples(index=False)]
    return list(df.columns), sorted(rows)


@pytest.mark.parametrize("plan,name", CASES, ids=[k for _, k in CASES])
def test_oracle(spark, duck, plan, name):
    got, want = plan.QUERIES[name](spark, SF).toPandas(), duck.execute(plan.SQL[name]).df()
    assert [c for c in sorted(got.columns)] == sorted(want.columns)
    assert table(got) == table(want)
