"""Hard negatives against all scores of small tables."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.llm import oracle, queries, vp_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string"


def plain(rows, every=5):
    seen = sorted({(i, y, tuple(math.floor(256 * np.float32(x).item()) for x in v)) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in seen:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, z) for j, z, w in seen if j != i)
        for p in [o for o in others if o[2] == y][:5]:
            fit = [o for o in others if o[2] != y and 50 * -p[0] <= 100 * -o[0] <= 95 * -p[0]][:3]
            out += [(i, p[1], r + 1, o[1], -p[0], -o[0]) for r, o in enumerate(fit)]
    return sorted(out)


def found(spark, rows, every=5, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, vp_negatives.mine(df, F.col("id") % every == 0, **sizes).collect()))


def vectors(n, seed=1, width=6, labels=4):
    r = random.Random(seed)
    return [(i, [r.gauss(0.2, 1) for _ in range(width)], r.randrange(labels)) for i in range(n)]


def test_equals_all_scores_over_many_blocks(spark):
    rows = vectors(400)
    assert found(spark, rows, least=40, leaf=8) == plain(rows)


def test_copies_ties_nulls_and_widths(spark):
    rows = vectors(60, 2)
    rows += [(100 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(90)]  # a third and more are one vector
    rows += [(200, [1.0, 0.25], 1), (201, [], 1), (202, None, 1), (203, [None, 1.0], 1), (204, [math.inf], 2), (205, [math.nan, 1.0], 2), (206, [1.0], None), (None, [1.0], 1), (5, rows[5][1], rows[5][2]), (210, [2.0, 1.0], 3)]
    assert found(spark, rows, least=20, leaf=4) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []


def test_large_components_are_exact():
    a, x = np.array([[3e9, 1.0]]), np.array([[2e9 + 1, 3.0], [3e9, -1.0], [-3e9, 5.0]])
    assert vp_negatives.scores(a, x, 9e18).tolist() == [[3 * 10**9 * (2 * 10**9 + 1) + 3, 9 * 10**18 - 1, -9 * 10**18 + 5]]


def test_leaves_are_passed_over():
    r = np.random.default_rng(3)
    centres = r.normal(0, 300, (16, 8)).round()
    x = np.floor(centres[r.integers(0, 16, 4000)] + r.normal(0, 4, (4000, 8)))
    top = (x * x).sum(1).max()
    tree = vp_negatives.build(x, top, 6)
    assert sorted(np.concatenate(tree.leaves)) == list(range(4000))
    most, least = vp_negatives.bounds(tree, x[:50], top)
    s = x[:50] @ x.T
    for at, rows in enumerate(tree.leaves):
        assert (s[:, rows] <= most[:, [at]]).all() and (s[:, rows] >= least[:, [at]]).all()
    assert (most < np.sort(s, 1)[:, [-5]]).mean() > 0.2


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want, got = con.sql(oracle.ORACLE["op11_hard_negatives"]), queries.op11_hard_negatives(spark, sf)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(want.fetchall())
