"""The stream of read files: totals over batches equal one run over all pairs."""

from __future__ import annotations

import random

from helixmill.operators import variants
from helixmill.streaming import microbatch


def test_stream_equals_one_run(spark, tmp_path):
    rng = random.Random(3)
    bases = "".join(rng.choices("ACTG", k=900))
    turn = str.maketrans("ACTG", "TGAC")
    pairs = []
    for i, p in enumerate((0, 30, 150, 300)):
        one = bases[p : p + 59] + {"A": "C", "C": "T", "T": "G", "G": "A"}[bases[p + 59]] + bases[p + 60 : p + 120]
        pairs.append((i, one, bases[p + 230 : p + 350].translate(turn)[::-1]))
    genome = spark.createDataFrame([(1, bases)], "seq_nr long, bases string")
    source = str(tmp_path / "in")
    store, seen = str(tmp_path / "store"), []
    for half in (pairs[:2], pairs[2:]):  # each time all queries start anew from their checkpoints
        spark.createDataFrame(half, microbatch.PAIRS).coalesce(1).write.mode("append").parquet(source)
        microbatch.start(spark, source, genome, store, str(tmp_path / "state")).awaitTermination()
        for q in microbatch.accumulate(spark, store, str(tmp_path / "sums")):
            q.awaitTermination()
            seen.append(sum(p["numInputRows"] for p in q.recentProgress))
    got = {(r.pos, r.ref, r.alt, r.depth) for r in microbatch.totals(spark, store).collect()}
    covs = {(r.pos, r.cov) for r in microbatch.totals(spark, store).collect()}
    assert sum(seen[::2]) == spark.read.parquet(f"{store}/calls").count() and sum(seen[1::2]) == spark.read.parquet(f"{store}/starts").count()  # no file twice
    _, starts = microbatch.call_pairs(spark.createDataFrame(pairs, microbatch.PAIRS), genome)
    at = [r.pos for r in starts.collect()]
    assert covs == {(pos, sum(s <= pos < s + 120 for s in at)) for pos, *_ in got}
    calls, _ = microbatch.call_pairs(spark.createDataFrame(pairs, microbatch.PAIRS), genome)
    assert got == {(r.pos, r.ref, r.alt, r.depth) for r in variants.aggregate(calls).collect()}
    assert got == {(p + 60, bases[p + 59], one[59], 1) for (_, one, _), p in zip(pairs, (0, 30, 150, 300), strict=True)}
