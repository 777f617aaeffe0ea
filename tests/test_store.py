"""The store of packed blocks against whole sequences."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from helixmill.operators import index, store


def genome(spark, sizes, seed=1):
    r = random.Random(seed)
    bases = {i: "".join(r.choices("ACTGN", [9, 9, 9, 9, 1], k=n)) for i, n in enumerate(sizes)}
    return bases, spark.createDataFrame(list(bases.items()), "seq_nr long, bases string")


def test_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 129):
        codes = r.integers(0, 4, n).astype(np.uint8)
        assert store.unpack(store.pack(codes), n).tolist() == codes.tolist()


def test_store_round_trip_and_ranges(spark, tmp_path):
    bases, df = genome(spark, (0, 5, 1024, 1025, 5000))
    path = str(tmp_path / "g")
    store.write_genome(df, path)
    blocks = store.read_genome(spark, path)
    assert {r.seq_nr: r.seq_len for r in store.lengths(blocks).collect()} == {i: len(b) for i, b in bases.items() if b}
    wanted = [(i, a, b) for i in bases for a, b in ((1, len(bases[i])), (1, 1), (900, 1200), (1024, 1024), (1025, 1025), (3, 4999), (7, 3), (6000, 6100))]
    found = store.bases_at(blocks, spark.createDataFrame(sorted(set(wanted)), "seq_nr long, first long, last long")).collect()
    assert {(r.seq_nr, r.first, r.last): r.found for r in found} == {(i, a, b): bases[i][a - 1 : max(b, 0)] if b >= a else "" for i, a, b in wanted}
    plan = blocks.where("seq_nr = 3 AND block = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block,1)" in plan
    with pytest.raises(FileExistsError):
        store.write_genome(df, path)
    with pytest.raises(ValueError):
        store.around(df, blocks, "seq_nr", 0, 10_000, "x")


def test_another_version_is_refused(spark, tmp_path):
    path = tmp_path / "g"
    store.write_genome(genome(spark, (100,))[1], str(path))
    meta = next(f for f in (path / "meta").iterdir() if f.name.startswith("part"))
    meta.write_text(meta.read_text().replace('"version": 1', '"version": 7'))
    (path / "meta" / f".{meta.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="version"):
        store.read_genome(spark, str(path))


def test_positions_and_runs(spark):
    bases, df = genome(spark, (117, 118, 1300, 2500), 4)
    bases[9] = "AC" + "T" * 40 + "N" * 20 + "ACTG" * 300
    df = df.unionByName(spark.createDataFrame([(9, bases[9])], df.schema))
    code = lambda s: int(s.translate(str.maketrans("ACTGN", "01230")), 4)
    want = set()
    for i, b in bases.items():
        want |= {(i, p, code(b[p : p + 14]), *(code(b[p + 14 + k : p + 40 + k]) for k in (0, 26, 52, 78))) for p in range(len(b) - 117) if "N" not in b[p : p + 14]}
    got = list(map(tuple, index.positions(df).collect()))
    assert len(got) == len(want) and set(got) == want
    runs = {(i, p) for i, b in bases.items() for p in range(12, len(b)) if len(set(b[p - 12 : p])) == 1}
    assert {tuple(r) for r in index.homopolymers(df).collect()} == runs and runs


def test_cutting_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "ACTGGTCA" * (n // 8))], "seq_nr long, bases string")
        started = time.time()
        assert store.cut(df).selectExpr("sum(size)").first()[0] == n
        return time.time() - started

    seconds(8000)
    small = min(seconds(500_000) for _ in range(2))
    assert min(seconds(2_000_000) for _ in range(2)) < 6 * small + 0.5
