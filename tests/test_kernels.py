"""Alignment kernels against plain scalar definitions, and planted variants end to end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import evaluate, index, kernels, mapping, pairing, simulate, telemetry, variants


def plain_gapped(a, b, most):
    n, inf = len(a), kernels.NONE
    d = {(0, j): 10 * j for j in range(8)} | {(i, 0): 10 * i for i in range(8)}
    p, q = {}, {}
    for i in range(1, n + 1):
        row = []
        for j in range(max(1, i - 7), min(n, i + 7) + 1):
            p[i, j] = min(d.get((i, j - 1), inf) + 11, p.get((i, j - 1), inf) + 1)
            q[i, j] = min(d.get((i - 1, j), inf) + 11, q.get((i - 1, j), inf) + 1)
            d[i, j] = min(d.get((i - 1, j - 1), inf) + 10 * (a[i - 1] != b[j - 1]), p[i, j], q[i, j])
            row.append(d[i, j])
        if i < n - 7 and min(row) > most:
            return min(row)
    return min([inf, *(d[i, n] for i in range(n - 7, n + 1)), *(d[n, j] for j in range(n - 7, n + 1))])


def pair(rng, edits):
    a = "".join(rng.choice("ACTG") for _ in range(130))
    b = list(a)
    for _ in range(edits):
        p = rng.randrange(len(b))
        b[p : p + 1] = rng.choice([[rng.choice("ACTG")], [], [b[p], rng.choice("ACTG")]])
    return a[:104], "".join(b)[:104]


def test_gapped_scores():
    rng = random.Random(3)
    pairs = [pair(rng, i % 5) for i in range(60)]
    x, y = (kernels.codes([p[k] for p in pairs]) for k in (0, 1))
    assert kernels.gapped(x, y, 40).tolist() == [plain_gapped(a, b, 40) for a, b in pairs]


def test_scores():
    rng = random.Random(4)
    a = "".join(rng.choice("ACTG") for _ in range(104))
    b = a[:50] + {"A": "C", "C": "T", "T": "G", "G": "A"}[a[50]] + a[51:]
    assert kernels.score([a, a, a], [a, b, a[:40] + a[41:] + "A"], 40).tolist()[:2] == [0, 10]
    assert 0 < kernels.score([a], [a[:40] + a[41:] + "A"], 40)[0] <= 12
    assert kernels.score([], [], 40).tolist() == []


@pytest.mark.parametrize("size", range(1, 6))
def test_traced_variants(size):
    rng = random.Random(size)
    g = "".join(rng.choice("ACTG") for _ in range(400))
    read = g[100:160] + g[160 + size : 160 + size + 60]
    (at, ref, alt), *more = kernels.variants(g, 100, read, 11 + size - 1)
    assert not more and g[:at] + alt + g[at + len(ref) :] == g[:160] + g[160 + size :]
    extra = "".join(rng.choice("ACTG") for _ in range(size))
    read = (g[100:160] + extra + g[160:])[:120]
    (at, ref, alt), *more = kernels.variants(g, 100, read, 11 + size - 1)
    assert not more and g[:at] + alt + g[at + len(ref) :] == g[:160] + extra + g[160:]


def plain_trace(genome, read):
    n, inf, reach = len(read), kernels.NONE, kernels.REACH
    d = {(0, k): 10 * k for k in range(reach + 1)} | {(k, 0): 10 * k for k in range(reach + 1)}
    p, q, step = {}, {}, {}
    for i in range(1, n + 1):
        for j in range(max(1, i - reach), min(n, i + reach) + 1):
            p[i, j] = min(d.get((i, j - 1), inf) + 11, p.get((i, j - 1), inf) + 1)
            q[i, j] = min(d.get((i - 1, j), inf) + 11, q.get((i - 1, j), inf) + 1)
            differ = genome[i - 1] != read[j - 1]
            diagonal, gap = d.get((i - 1, j - 1), inf) + 10 * differ, min(p[i, j], q[i, j])
            d[i, j] = min(diagonal, gap)
            step[i, j] = int(differ) if diagonal < gap else 2 if p[i, j] < q[i, j] else 3
    ends = [(i, n) for i in range(n - reach, n + 1)] + [(n, j) for j in range(n - reach, n + 1)]
    i, j = min(ends, key=lambda e: d[e])
    i, j = (i, j) if d[i, j] < inf else (0, 0)
    out = []
    while i > 0 and j > 0:
        s = step.get((i, j), 0)
        i, j = i - (s != 2), j - (s != 3)
        if s:
            out.append((("SUB", "INS", "DEL")[s - 1], i, j))
    return out[::-1]


def test_batches_are_traced_like_single_pairs():
    rng = random.Random(8)
    pairs = [(a[:60], b[:60]) for a, b in (pair(rng, k % 7) for k in range(70))] + [("ACNN" * 15, "ACTN" * 15), ("A" * 60, "T" * 60)]
    codes = [kernels.SYMBOL_CODES[[[ord(c) for c in x[k]] for x in pairs]] for k in (0, 1)]
    assert kernels.traces(*codes) == [plain_trace(a, b) for a, b in pairs]
    windows = [a + "ACTGACTG" for a, _ in pairs]
    whole = kernels.variants_of(windows, [0] * len(pairs), [b for _, b in pairs], [20] * len(pairs))
    assert whole == [kernels.variants(w, 0, b, 20) for w, (_, b) in zip(windows, pairs)]
    assert kernels.variants_of([], [], [], []) == []


def test_calls_in_sql(spark):
    rng = random.Random(5)
    bases = "".join(rng.choice("ACTG") for _ in range(600))
    genome = spark.createDataFrame([(1, bases)], "seq_nr long, bases string")
    reads = [(k, 1, s, 11 + k % 3, bases[s : s + 50] + bases[s + 51 + k % 3 : s + 121 + k % 3]) for k, s in enumerate(range(0, 400, 40))]
    placed = spark.createDataFrame(reads, "num long, seq_nr long, start long, score int, seq string")
    variants.register(spark)
    variants.windows(placed, genome).createOrReplaceTempView("placed_windows")
    got = spark.sql("SELECT seq_nr, pos, ref, alt, score FROM align_variants(TABLE(SELECT * FROM placed_windows)) ORDER BY ALL").collect()
    want = sorted(map(tuple, variants.call_variants(placed, genome).collect()))
    assert len(want) >= 10 and [tuple(r) for r in got] == want
    for _, pos, ref, alt, score in want:
        assert bases[pos - 1 : pos - 1 + len(ref)] == ref and len(ref) - len(alt) == score - 10


def test_planted_variants_are_called(spark):
    rng = random.Random(9)
    bases = "".join(rng.choice("ACTG") for _ in range(6000))
    genome = spark.createDataFrame([(1, bases)], "seq_nr long, bases string")
    planted = []
    for k, pos in enumerate(range(300, 5600, 150)):
        ref = bases[pos - 1]
        if k % 3 == 0:
            planted.append((1, pos, ref, "CTGA"["ACTG".index(ref)]))
        elif k % 3 == 1:
            planted.append((1, pos, bases[pos - 1 : pos + 2], ref))
        else:
            planted.append((1, pos, ref, ref + "".join(rng.choice("ACTG") for _ in range(2))))
    chosen = spark.createDataFrame(planted, "seq_nr long, pos long, ref string, alt string")
    pairs = simulate.simulate_pairs(simulate.planted(genome, chosen), step=12)
    hits = mapping.map_reads(pairs, genome)
    resolved = pairing.resolve(pairing.best_pairs(pairing.pair_candidates(hits)))
    calls = variants.aggregate(variants.call_variants(variants.mates(resolved, mapping.orient(pairs)), genome))
    kept = variants.filter_variants(variants.with_coverage(calls, resolved), genome)

    def normal(rows):
        out = set()
        for pos, ref, alt in rows:
            out.add((bases[: pos - 1] + alt + bases[pos - 1 + len(ref) :]))
        return out

    got, want = normal((r.pos, r.ref, r.alt) for r in kept.collect()), normal((p, r, a) for _, p, r, a in planted)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_index_round_trip(spark, tmp_path):
    genome = spark.createDataFrame([(0, "ACTG" * 60), (1, "ACTGN" * 40), (2, "AC")], "seq_nr long, bases string")
    seeds = index.positions(genome)
    chunked = index.chunked(seeds, size=10).collect()
    assert len({(r.seed, r.ord) for r in chunked}) == len(chunked) == seeds.count()
    sizes = {}
    for r in chunked:
        sizes[r.seed, r.chunk_id] = sizes.get((r.seed, r.chunk_id), 0) + 1
    assert max(sizes.values()) <= 10
    assert sizes == {(r.seed, r.chunk_id): r.nb_nbr for r in index.chunk_sizes(index.histogram(seeds), size=10).collect()}
    path = str(tmp_path / "i")
    index.write_index(genome, path, parts=4, size=10)
    kept = index.read_index(spark, path)
    want = sorted((r.seed, r.chunk_id, r.seq_nr, r.seed_nr, *(r[w] for w in index.WORDS)) for r in chunked)
    assert sorted(map(tuple, kept.rows.collect())) == want
    some = index.read_index(spark, path, part_ids=[0, 2])
    assert all(f.rsplit("_", 1)[1][:5] in ("00000", "00002") for f in some.rows.inputFiles())
    assert some.rows.count() + index.read_index(spark, path, part_ids=[1, 3]).rows.count() == len(want)
    with pytest.raises(FileExistsError):
        index.write_index(genome, path, parts=4)
    meta = next(f for f in (tmp_path / "i" / "meta").iterdir() if f.name.startswith("part"))
    (meta.parent / f".{meta.name}.crc").unlink(missing_ok=True)
    meta.write_text('{"magic": "x", "version": 1, "seed": 14, "neighbour": 104}')
    with pytest.raises(ValueError):
        index.read_index(spark, path)


def test_a_stored_index_is_joined_where_it_lies(spark, tmp_path):
    rng = random.Random(2)
    bases = "".join(rng.choice("ACTG") for _ in range(3000)) + "A" * 800
    genome = spark.createDataFrame([(1, bases), (2, bases[500:1500])], "seq_nr long, bases string")
    pairs = spark.createDataFrame([(i, bases[p : p + 120], bases[p + 200 : p + 320]) for i, p in enumerate((0, 700, 1400, 3100))], "pair_id long, seq1 string, seq2 string")
    path = str(tmp_path / "i")
    index.write_index(genome, path, parts=4, size=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mapping.candidates(mapping.probes(mapping.orient(pairs)), index.read_index(spark, path))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
        side = max(i for i in range(scan) if plan[i].startswith("      +- "))  # the join's second child
        assert "Join" in plan[2] and not any("Exchange" in line for line in plan[side : scan + 1])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for gaps in (False, True):
        stored = mapping.map_reads(pairs, index.read_index(spark, path), gaps).drop("chunk_id").distinct()
        fresh = mapping.best(mapping.scored(mapping.candidates(mapping.probes(mapping.orient(pairs)), index.Index(index.chunked(index.positions(genome), 100), index.common(index.histogram(index.positions(genome)), 100))), gaps)).drop("chunk_id").distinct()
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fresh.collect())) and stored.count() >= 16


def test_symbols_that_no_byte_holds(spark):
    from helixmill.functions import codec

    text = "ACTG" * 20 + "“漢字”" + "ACCA" * 30
    rows = spark.createDataFrame([(0, text), (1, text.replace("漢", "語")), (2, None)], "k long, t string")
    encoded = [r.s for r in rows.select("k", codec.encode_text(F.col("t")).alias("s")).orderBy("k").collect()]
    assert encoded[0] == encoded[1] == "ACTG" * 20 + "NNNN" + "ACCA" * 30 and encoded[2] is None
    assert kernels.score(["A“" * 52, "CA" * 52], ["AA" * 52, "CN" * 52], 40).tolist() == [0, 0]
    genome = spark.createDataFrame([(1, encoded[0])], "seq_nr long, bases string")
    pairs = spark.createDataFrame([(0, encoded[0][:120], codec_reverse(encoded[0][84:]))], "pair_id long, seq1 string, seq2 string")
    hits = mapping.map_reads(pairs, genome)
    assert {(r.num, r.seed_nr, r.score) for r in hits.collect()} >= {(0, 0, 0)}
    placed = spark.createDataFrame([(0, 1, 0, 10, encoded[0][:60] + "C" + encoded[0][61:120])], "num long, seq_nr long, start long, score int, seq string")
    assert [(r.pos, r.ref, r.alt) for r in variants.call_variants(placed, genome).collect()] == [(61, "A", "C")]
    assert [(r.pos, r.ref, r.alt) for r in variants.call_substitutions(placed, genome).collect()] == [(61, "A", "C")]


def codec_reverse(s):
    return s.translate(str.maketrans("ACTG", "TGAC"))[::-1]


def test_gate(spark):
    rows = spark.createDataFrame([("SUB", 1, i, "A", "C") for i in range(100)], "cls string, chr int, pos int, ref string, alt string")
    good = evaluate.report(evaluate.compare(rows, rows))
    evaluate.assert_quality(good)
    with pytest.raises(AssertionError):
        evaluate.assert_quality(evaluate.report(evaluate.compare(rows.where("pos < 50"), rows)))


def test_svg_and_spans(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "stage string, t double")
    found = telemetry.spans(telemetry.from_first(rows, "t"), ["stage"], "t")
    assert [tuple(r) for r in found.collect()] == [("a", 0.0, 2.0)]
    assert telemetry.svg_lines(found, "stage", {"a": "red"}).first().line == '<line x1="0.00" y1="10" x2="2.00" y2="10" stroke="red"/>'
