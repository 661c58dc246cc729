"""Every registered query against its DuckDB SQL on the small fixture."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def _rows(pdf):
    """Column names, and rows in an order that the last digits of floats don't change."""
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: repr([float(f"{x:.6g}") if isinstance(x, float) else x for x in r]))


def _same(a, b):
    """Equal values; floats to nine digits, as sums are taken in another order."""
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf, con, key):
    got_cols, got = _rows(E.queries()[key](spark, sf).toPandas())
    want_cols, want = _rows(con.execute(E.oracle_sql()[key]).df())
    assert got_cols == want_cols and len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(_same, g, w))]
    assert not wrong, wrong[:3]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
