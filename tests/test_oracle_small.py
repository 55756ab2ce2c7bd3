"""Every registered query with an oracle agrees with DuckDB on sf0.001 (same check as the round driver)."""
import math

import duckdb
import pandas as pd
import pytest

from casekit.plans import registry
from conftest import SF_SMALL

registry.load_all()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = registry.QUERIES[name](spark, SF_SMALL).toPandas()
    dp = con.execute(registry.ORACLE[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dp)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
