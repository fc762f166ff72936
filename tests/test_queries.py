"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os
from datetime import date

import duckdb
import pytest

from signalpanel.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: MLlib's fits and the ablation loop are timed by bench.py and compared in test_operators.py.
SLOW = {"gbt_oof_auc", "logistic_oof_auc", "tuning_headroom", "ablation_trace"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v) if isinstance(v, date) else repr(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want.fetchall())
    # figures of six decimals may round apart in the last one
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or abs(float(p) - float(q)) <= 2e-6
