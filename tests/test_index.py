"""Seed counts in packed parts, and positions of the asked seeds alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixmill.functions.codec import encode_text
from helixmill.operators import index, mapping, pairing, store
from helixmill.plans import fixtures as fx
from pyspark.sql import functions as F


def test_counts_travel_in_few_bytes_a_seed():
    rng = np.random.default_rng(1)
    seeds = np.concatenate([rng.integers(0, 1 << 28, 1 << 22), np.full(300, 5), np.full(70_000, (1 << 28) - 1)])
    sent = index._sent(seeds)
    want = dict(zip(*(x.tolist() for x in np.unique(seeds, return_counts=True)), strict=True))
    assert sum(map(len, sent["packed"].to_pylist())) < 3 * len(want)
    twice = [b for k in range(sent.num_rows) for b in (sent.slice(k, 1), sent.slice(k, 1))]
    got = {s: n for b in index._summed(iter(twice)) for s, n in zip(b["seed"].to_pylist(), b["n"].to_pylist(), strict=True)}
    assert got == {s: 2 * n for s, n in want.items()}


def test_blocks_of_texts_are_those_of_their_symbols(spark):
    texts = spark.createDataFrame([(1, "?é Ab\0cdЖ\U0001f600" * 400), (2, ""), (3, None)], "seq_nr long, text string")
    of_bases = store.cut(texts.select("seq_nr", encode_text(F.coalesce("text", F.lit(""))).alias("bases")))
    assert sorted(map(tuple, store.of_texts(texts).collect())) == sorted(map(tuple, of_bases.collect()))


def test_only_asked_positions_are_made_and_chunked_alike(spark, sf):
    g = fx.blocks(spark, sf)
    whole = index.chunked(index.positions(g), 20).drop("ord", "n")
    asked = index.histogram(index.positions(g)).where("n > 20 OR seed % 7 = 0").select("seed")
    here = index.used(g, asked, 20)
    assert here.rows.count() == index.positions(g).join(asked, "seed", "left_semi").count()
    assert here.common.count() > 0
    got = index.located(here.rows, here.common, here.before, 20).select(*whole.columns)
    want = whole.join(asked, "seed", "left_semi").select(*whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = index.marked_positions(g, index.marked(asked))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_task_sends_each_seed_once(monkeypatch):
    monkeypatch.setattr(index, "COUNTED", 500)
    rng = np.random.default_rng(2)
    bases = ["".join(rng.choice(list("ACTG"), 3000)), "A" * 3000]
    rows = [(i, bases[i % 2]) for i in range(6)]
    codes = [store._of_bases(b) for _, b in rows]
    blocks = list(store._rows(iter([pa.RecordBatch.from_pydict({"seq_nr": [i for i, _ in rows], "bases": [b for _, b in rows]})])))
    seeds = np.concatenate([index._seeds(i, 0, 0, len(c), c, False)[2] for i, c in enumerate(codes)])
    want = dict(zip(*(x.tolist() for x in np.unique(seeds, return_counts=True)), strict=True))
    sent = list(index._counted(iter(blocks)))
    assert sum(sum(b["n"].to_pylist()) for b in sent) == len(want)

    def summed(sent):
        rows = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: r["part"])
        out = index._summed(iter([pa.RecordBatch.from_pylist(rows)]))
        return {s: n for b in out for s, n in zip(b["seed"].to_pylist(), b["n"].to_pylist(), strict=True)}

    assert summed(sent) == want
    monkeypatch.setattr(index, "HELD", 1000)  # more seeds than a task adds up
    many = list(index._counted(iter(blocks)))
    assert len(many) > 1 and summed(many) == want
    assert list(index._counted(iter([]))) == []
