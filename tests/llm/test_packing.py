"""Best-fit packing: ids as the defining library gives them, exact places, and as few bins as possible."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from helixmill.llm import _tokens, gga_pack, pfair_mix

TEXTS = [None, "", "a", "word " * 5000, "<|endoftext|> hi", "日本 😀\x00 é", " \n\n  x", "same", "same"]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + TEXTS
    for text in texts:
        assert _tokens.ids(_tokens.default_path(), text).tolist() == reference_ids(text)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "7" * 1_000_000, "x" * 1_000_000, "é" * 500_000, "!" * 1_000_000, "\n" * 1_000_000])
def test_long_runs_are_encoded(text):
    assert _tokens.ids(_tokens.default_path(), text).tolist() == reference_ids(text)


def test_every_id_has_one_place(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i // 2, t) for i, t in enumerate(TEXTS)] + [(None, "x")], docs.schema))
    rows = gga_pack.pack_documents(docs).collect()
    want = Counter()
    for d in docs.collect():
        ids = np.array([*reference_ids(d.text), 0], "<u4")
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d.doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_sequences_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "again"), (3, "word " * 3000)], "doc_id long, text string")
    cut = gga_pack.written(gga_pack.pieces(docs, with_ids=True))
    made = {r.sequence_id: bytes(r.ids) for r in gga_pack.sequences(gga_pack.pack(cut)).collect()}
    ids = np.concatenate([np.frombuffer(b, "<u4") for b in made.values()])
    assert sorted(ids.tolist()) == sorted(sum(([*reference_ids(r.text), 0] for r in docs.collect()), []))


@pytest.mark.parametrize("seed", range(3))
def test_crossover_keeps_the_pieces(seed):
    rng = np.random.default_rng(seed)
    total = Counter(rng.integers(1, 100, 400).tolist())
    alive = gga_pack.evolve(total, [], 100, 6, 12, seed)
    for p in alive:
        pieces = Counter()
        for b, n in p.items():
            assert sum(b) <= 100
            for s in b:
                pieces[s] += n
        assert pieces == total


def test_evolution_is_no_worse_than_best_fit_decreasing():
    # pieces that fit together in several ways, of which longest first takes poor ones
    total = Counter({44: 20, 24: 20, 22: 20, 21: 20, 17: 20, 8: 20, 6: 20, 58: 20})
    plain = sum(gga_pack.best_fit(gga_pack.Bins(100), sorted(total.items(), reverse=True)).values())
    best = sum(gga_pack.evolve(total, [], 100, 12, 200, 3)[0].values())
    assert gga_pack.lower_bound(total, 100) <= best <= plain


def test_empty_table_and_clashing_names(spark):
    assert gga_pack.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, offset long, length long")
    assert gga_pack.pack_documents(odd).count() == 1


def test_packing_follows_the_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (200 + 7 * i % 300), "ab"[i % 2]) for i in range(400)] + [(None, "word " * 5000, "a"), (1, "", None)], "doc_id long, text string, source string")
    made = {}
    for weights in ({"a": 0.9, "b": 0.1}, {"a": 0.1, "b": 0.9}):
        mixed = pfair_mix.in_order(docs, numbered="mix_place", weights=weights, block=4)
        rows = gga_pack.pack_documents(mixed, order="mix_place", span=100).collect()
        ends, pieces = {}, Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
        assert len(ends) <= 1.1 * sum(r.length for r in rows) / 2048 + 5
        early = [r.doc_id for r in rows if r.sequence_id < len(ends) // 4 and r.doc_id is not None]
        made[weights["a"]] = pieces, {(r.doc_id, r.piece): r.sequence_id for r in rows}, sum(i % 2 == 0 for i in early) / len(early)
    assert made[0.9][0] == made[0.1][0] == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in gga_pack.pack_documents(docs).collect())
    assert made[0.9][1] != made[0.1][1] and made[0.9][2] > 0.75 > 0.25 > made[0.1][2]
    assert gga_pack.pack_documents(mixed.limit(0), order="mix_place").count() == 0
