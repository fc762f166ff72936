import random

import numpy as np
import pytest

from signalpanel.llm import embedding
from signalpanel.llm.components import components


def brute(rows, threshold):
    ok = [r[1] is not None and r[2] is not None and len(r[2]) > 0 and all(e is not None and np.isfinite(e) for e in r[2]) and any(r[2]) for r in rows]
    x = [np.array(r[2]) / np.linalg.norm(r[2]) if o else None for r, o in zip(rows, ok)]
    near = lambda i, j: i != j and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold
    links = [[j for j in range(len(rows)) if near(i, j)] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] is not None and rows[i][0] == component))
    return out


def table(seed=0, n=300):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = r.normal(size=8) if not rows or r.random() < 0.4 else np.array(rows[r.integers(len(rows))][2]) + r.normal(size=8) * r.choice([0.01, 0.2, 0.4])
        rows.append((i, int(r.integers(3)) if r.random() > 0.5 or not rows else rows[-1][1], [float(v) for v in base]))
    rows += [(500 + i, 1, rows[7][2]) for i in range(20)] + [(600, None, rows[7][2]), (601, 1, None), (602, 1, []), (603, 1, [0.0] * 8), (604, 1, [1.0, float("nan")] + [0.0] * 6), (605, 1, [1.0, None] + [0.0] * 6), (606, 1, [1.0, 2.0]), (607, 1, [1.0, 2.0]), (None, 2, rows[9][2]), (None, 2, rows[9][2]), (610, 2, [5e200] * 8), (611, 2, [5e200] * 8)]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, block):
    rows = table()
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "vec_id long, label int, embedding array<double>, key int, cell string")
    rows[-2:] = [(610, 2, [1.0] * 8), (611, 2, [1.0] * 8)]  # squares overflow in the brute force alone
    got = [tuple(x) for x in embedding.near_duplicates(df, 0.93, cells=12, block=block).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows, 0.93), key=order)


def test_empty(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500 + i) for i in range(50)] + [(7, 7), (None, 1)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
