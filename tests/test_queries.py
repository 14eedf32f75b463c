"""Every registered query of the series operators against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from voltrail.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame, columns, keys):
    """Rows in order of their keys, then of their rounded values."""

    def plain(v):
        if pd.isna(v):
            return ""
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    table = [tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)]
    order = lambda r: ([str(r[i]) for i in keys], [round(v, 3) for v in r if isinstance(v, float)])
    return sorted(table, key=order)


def key_columns(got, want, columns):
    """Columns of texts and whole numbers."""
    whole = lambda v: not isinstance(v, float) or math.isnan(v) or v.is_integer()
    return [i for i, c in enumerate(columns) if all(map(whole, [*got[c].astype(object), *want[c].astype(object)]))]


def close(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    keys = key_columns(got, want, columns)
    assert all(close(x, y) for a, b in zip(rows(got, columns, keys), rows(want, columns, keys)) for x, y in zip(a, b))


def test_the_others_have_plain_tests():
    """Queries without SQL are compared row by row in test_plain and test_regress."""
    text = "".join((Path(__file__).parent / f).read_text() for f in ("test_plain.py", "test_regress.py"))
    assert [n for n in sorted(set(QUERIES) - set(ORACLES)) if f'"{n}"' not in text] == []
