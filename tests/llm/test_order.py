"""Mixing and training order: windows, permutations and exact round trips."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from helixmill.llm import _tokens, feistel_shards, pfair_mix, queries


@pytest.mark.parametrize("shares", [[1], [1, 1, 1], [7, 2, 1], [500, 300, 150, 49, 1], [3, 3, 3, 1]])
def test_every_block_is_in_its_window(shares):
    total, slots = sum(shares), pfair_mix.schedule(shares)
    assert sorted(sum(slots, [])) == list(range(total))
    for c, at in zip(shares, slots):
        for i, t in enumerate(at):
            assert i * total // c <= t < -(-(i + 1) * total // c)
            assert abs((i + 1) - (t + 1) * c / total) < 1


def test_mix_keeps_rows_and_windows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", i) for i in range(3000)] + [(None, None, 1), (5, "hot", 2), (5, "hot", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    out = pfair_mix.mix(docs, block=4, period=50).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((a, b) for a, b, _ in rows)
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert len({(r.slot, r.place) for r in out}) == len(out)
    blocks = defaultdict(set)
    for r in out:
        blocks[r.slot].add((r.source, r.block))
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks)))


def test_mix_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)], "doc_id long, source string")
    out = pfair_mix.mix(docs, weights={"a": 0.8, "b": 0.2}, block=10, period=10).collect()
    for upto in (10, 55, 200):
        got = len({r.slot for r in out if r.source == "a" and r.slot < upto})
        assert abs(got - 0.8 * upto) < 1
    ordered = pfair_mix.in_order(docs, weights={"a": 0.8, "b": 0.2}, block=10)
    assert ordered.columns == docs.columns and ordered.count() == 4000
    assert pfair_mix.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 65537])
def test_permutation(n):
    x = np.arange(n)
    p = feistel_shards.permuted(x, n, 42)
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert (p != feistel_shards.permuted(x, n, 43)).mean() > 0.9 and np.abs(np.corrcoef(x, p)[0, 1]) < 0.2


def test_shards_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "x"), (3, None), (3, "")], docs.schema)).repartition(3)
    made = feistel_shards.written(feistel_shards.sequences(docs))
    placed = feistel_shards.materialise(made, 7, records=16)
    shards = feistel_shards.write_shards(placed, f"file://{tmp_path}").collect()
    rows = {r.slot: r for r in placed.collect()}
    n = len(rows)
    assert sorted(rows) == list(range(n)) and sum(s.records for s in shards) == n
    assert all(r.shard == r.slot // 16 and r.record == r.slot % 16 for r in rows.values())
    got = feistel_shards.read_from(f"file://{tmp_path}", 5, 40, records=16)
    assert all(got[i].tobytes() == bytes(rows[5 + i].ids) for i in range(40))
    ids = Counter()
    for r in rows.values():
        ids.update(np.frombuffer(r.ids, "<u2")[: r.n_ids].tolist())
    want = Counter()
    for d in docs.collect():
        want.update([*_tokens.ids(_tokens.default_path(), d.text).tolist(), 0])
    assert ids == want
    parts = defaultdict(list)
    for r in rows.values():
        parts[r.part].append(r)
    whole = Counter(b"".join(bytes(r.ids)[: 2 * r.n_ids] for r in sorted(p, key=lambda r: r.number)).count(b"\x00\x00") > 0 for p in parts.values())
    assert whole[True] == len(parts)
    assert feistel_shards.materialise_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("blocks", "weights"),
    [
        ({"a": 200, "b": 200}, {"a": 0.8, "b": 0.2}),
        ({"a": 4000, "b": 3, "c": 900}, {"a": 0.5, "b": 0.4, "c": 0.1}),
        ({"a": 5000, "b": 7}, {"a": 0.9996, "b": 0.0004}),
        ({f"s{i:02}": 4 for i in range(20)}, {f"s{i:02}": 1.0 + i for i in range(20)}),
    ],
)
def test_no_source_is_a_block_off_its_target(blocks, weights):
    got, left, target, t = dict.fromkeys(blocks, 0), dict(blocks), dict.fromkeys(blocks, Fraction(0)), 0
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    for slot, (s, i, at, release, deadline) in enumerate(pfair_mix.deal(blocks, weights)):
        assert at == slot and i == got[s] and release <= slot < deadline
        got[s] += 1
        room = Fraction(1)  # this slot's share for each source that isn't dry
        while room and (live := [k for k in blocks if target[k] < left[k]]):
            total = sum(exact[k] for k in live)
            step = min(room, *((left[k] - target[k]) * total / exact[k] for k in live))
            for k in live:
                target[k] += step * exact[k] / total
            room -= step
        assert all(abs(got[k] - target[k]) < 1 for k in blocks)
    assert got == blocks


def test_mix_follows_the_weights_at_the_production_period(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)], "doc_id long, source string")
    out = pfair_mix.mix(docs, weights={"a": 0.8, "b": 0.2}, block=10).collect()
    for upto in (10, 100, 250):
        assert abs(len({r.slot for r in out if r.source == "a" and r.slot < upto}) - 0.8 * upto) < 1
    late = pfair_mix.mix(docs, weights={"a": 1, "b": 0}, block=10).collect()
    assert max(r.slot for r in late if r.source == "a") == 199 and len({r.slot for r in late}) == 400


def test_training_order_writes_its_shards(spark, sf):
    rows = queries.op6_training_order(spark, sf).collect()
    shards = {}
    for r in sorted(rows, key=lambda r: r.slot):
        shards.setdefault((r.shard, r.shard_path, r.shard_crc32), []).append(bytes(r.ids))
    assert len({s for s, _, _ in shards}) == len(shards) == -(-len(rows) // feistel_shards.RECORDS)
    for (_, path, crc), ids in shards.items():
        data = Path(path.removeprefix("file://")).read_bytes()
        assert data == b"".join(ids) and zlib.crc32(data) == crc
