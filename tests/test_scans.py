"""Scans in buckets against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from helixmill.operators import scans


def table(spark, n=400, seed=1):
    r = random.Random(seed)
    at = r.sample(range(3000), n)
    rows = [(r.choice(["a", "b", None]), p, r.choice([None, *range(9)]), r.getrandbits(62)) for p in at]
    return rows, spark.createDataFrame(rows, "k string, at long, v long, x long").repartition(7)


def test_scans_equal_loops(spark):
    rows, df = table(spark)
    for keys in ((), ("k",)):
        out = scans.along(df, scans.bucket_of(F.col("at"), 100), ["at"], keys=keys, sums={"s": F.col("v")}, xors={"z": F.col("x")}, lasts={"l": F.col("v")}, lags={"g": F.col("v")}).collect()
        want, state = {}, {}
        for k, at, v, x in sorted(rows, key=lambda r: r[1]):
            s, z, last, lag = state.get(k if keys else 0, (0, 0, None, None))
            s, z, last = s + (v or 0), z ^ x, v if v is not None else last
            want[at], state[k if keys else 0] = (s, z, last, lag), (s, z, last, v)
        assert {r.at: (r.s, r.z, r.l, r.g) for r in out} == want


def test_ranks_and_clashing_names(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "line long, n long")
    out = {r.line: r.n for r in scans.numbered(df, scans.bucket_of(F.col("line"), 7), ["line"], "n", start=1).collect()}
    assert out == {i: i + 1 for i in range(50)}
    assert scans.numbered(df.where("line < 0"), scans.bucket_of(F.col("line"), 7), ["line"], "n").count() == 0


def test_null_order_comes_first(spark):
    df = spark.createDataFrame([(None, 5), (3, 1), (900, 2)], "at long, v long")
    out = scans.along(df, scans.bucket_of(F.col("at"), 10), [F.col("at").asc_nulls_first()], sums={"s": F.col("v")})
    assert sorted((r.v, r.s) for r in out.collect()) == [(1, 6), (2, 8), (5, 5)]
