"""Mate pairs that are counted and chosen where they meet, against all pairs."""

from __future__ import annotations

import random
from pathlib import Path

from helixmill.operators import mapping, pairing
from helixmill.plans import fixtures as fx
from helixmill.sources import shared


def hits_of(spark):
    rng = random.Random(3)
    rows = {(4 * rng.randrange(12) + rng.randrange(4), rng.randrange(5), rng.randrange(0, 3000, 60)): 10 * rng.randrange(3) for _ in range(900)}
    return spark.createDataFrame([(*k, s, chunk) for k, s in rows.items() for chunk in range(1 + k[2] % 2)], "num long, seq_nr long, seed_nr long, score int, chunk_id int")


def test_pairs_equal_loops(spark):
    hits = hits_of(spark)
    each = {(r.num // 4, r.num % 4, r.seq_nr, r.seed_nr, r.score) for r in hits.collect()}
    want = sorted((a[0], *a[1:], *b[1:]) for a in each for b in each if a[0] == b[0] and a[1] < 2 and a[1] + b[1] == 3 and 131 <= abs(a[3] - b[3]) <= 429)
    found = pairing.pair_candidates(hits)
    assert sorted(map(tuple, found.collect())) == want
    assert "_bucket" in next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    rows = lambda df: sorted(map(tuple, df.select(*pairing.PAIR, "total", "n_tied").collect()))
    assert rows(pairing.best_of(hits)) == rows(pairing.best_pairs(found))
    assert rows(pairing.choose(hits)) == rows(pairing.resolve(pairing.best_pairs(found)))


def test_only_able_hits_look_up_coverage(spark, monkeypatch):
    """Hits over their pair's least total are not carried through the scan of the coverage."""
    hits = hits_of(spark)
    total = {r.pair_id: r.total for r in pairing.best_of(hits).select("pair_id", "total").distinct().collect()}
    each = {(r.num // 4, r.num % 4, r.seq_nr, r.seed_nr, r.score) for r in hits.collect()}
    able = sorted(h for h in each if h[0] in total and h[4] <= total[h[0]])
    asked, look_up = [], pairing.coverage_at
    monkeypatch.setattr(pairing, "coverage_at", lambda points, *a: (asked.extend(points.select("pair_id", "type", "seq_nr", "pos", "score").collect()), look_up(points, *a))[1])
    pairing.choose(hits)
    assert sorted(map(tuple, asked)) == able and len(able) < len(each)


def test_hits_of_score_0_tell_the_unmapped(spark, sf):
    pairs, blocks = fx.paired_reads(spark, sf), fx.blocks(spark, sf)
    ids = lambda hits: sorted(r.pair_id for r in pairing.unmapped(hits, pairing.paired(hits.where("score = 0"), same_sequence=True)).collect())
    folder = Path(shared.folder(spark).removeprefix("file:"))
    there = set(folder.glob("kept-*"))
    best, exact = mapping.map_reads(pairs, blocks, gaps=False), mapping.exact_hits(pairs, blocks, gaps=False)
    assert len(set(folder.glob("kept-*")) - there) == 2  # the tables of the positions went
    assert ids(best) == ids(exact) and exact.count() < best.count()
    zero = lambda hits: sorted(map(tuple, hits.where("score = 0").select("num", "seq_nr", "seed_nr").distinct().collect()))
    assert zero(best) == zero(exact)


def test_reads_are_cut_before_they_move(spark, sf):
    """The windows equal those of whole encoded sequences, and no whole text is shuffled for them."""
    whole = {r.seq_nr: r.bases for r in fx.genome(spark, sf).collect()}
    reads = fx.paired_reads(spark, sf)
    for r in reads.collect():
        own = whole[r.pair_id][r.start : r.start + 350]
        assert r.seq1[:59] + r.seq1[60:] == own[:59] + own[60:120] and len(r.seq2) == 120
    gapped = {r.pair_id: r.seq1 for r in fx.gapped_reads(spark, sf).collect()}
    assert gapped == {r.pair_id: (lambda b, n: b[:59] + b[59 + n : 120 + n])(whole[r.pair_id][r.start :], 1 + r.pair_id % 5) for r in reads.collect()}
    plan = reads._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Repartition" in line)
    assert any("substring(" in line.lower() for line in plan[at:])
