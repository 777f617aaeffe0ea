"""The class-based model against plain counts, sums of probabilities and single moves."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import brown_lm, queries

SCHEMA = "doc_id long, text string, n_tokens string, score int"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def texts(n, seed=1):
    r = random.Random(seed)
    kinds = [["the", "a"], ["cat", "dog", "bird", "fish"], ["sees", "likes", "hunts"], ["Ärger", "été", "x\x00y"]]
    said = lambda: " ".join(r.choice(k) for k in kinds[:3]) + r.choice([" ", "\n", "  "]) + r.choice(kinds[r.choice([0, 0, 3])]) + r.choice(["", f" rare{r.randrange(40)}ing", f" Odd{r.randrange(40)}ed"])
    return [(i, " ".join(said() for _ in range(r.randrange(1, 6)))) for i in range(n)]


def base(rows, learning):
    c = Counter(t for _, x in rows if learning(_) for t in split(x))
    n, v = sum(c.values()), len(c)
    one = lambda x: (len(split(x)), sum(c[t] > 0 for t in split(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in split(x)))
    return [one(x) for _, x in rows]


def run(spark, rows, learning, **options):
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], SCHEMA).repartition(3)
    m = brown_lm.learn(df.where(F.col("doc_id").isin([i for i, _ in rows if learning(i)])), **options)
    return m, brown_lm.score(df, m, ["doc_id", "n_tokens"])


def test_base_columns_and_edges(spark):
    rows = [*texts(80), (100, None), (101, ""), (102, " \n"), (103, "Unknown word"), (104, "the " * 30_000), (105, "z" * 1_200_000)]
    learning = lambda i: i % 4 != 3
    m, out = run(spark, rows, learning, share=64, classes=6)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"] and len(got) == len(rows)
    for (i, _), (n, known, total, b) in zip(rows, base(rows, learning)):
        r = got[i]
        assert (r.n_tokens, r.n_known, m.tokens) == (n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9) and math.isfinite(r.score) and r.score < 0
        assert r.perplexity == pytest.approx(10 ** (-r.score / n))


def plain_log(m, counts, text):
    """log10 of the model's probability, a token at a time."""
    units, core = m.units, len(m.units.core)
    data = np.frombuffer((text or "").encode(), np.uint8)
    h, tails, ends, _ = brown_lm.tokens(data, np.array([0, len(data)]))
    before, out = m.classes[-1], 0.0
    for x, t, end, word in zip(h, tails, ends, split(text)):
        u = units.end if end else int(units.of(np.array([x]), np.array([t]))[0])
        out += m.steps[before, m.classes[u]] + m.emits[u]
        if core <= u < units.end:
            n, v = m.kinds[:, u - core]
            share = 1.0 if not n else (counts[word] - m.discount if counts[word] else m.discount * v) / n
            out += math.log10(share)
        before = m.classes[u]
    return out


def test_scores_equal_a_plain_sum_and_add_up(spark):
    rows, learning = texts(120, 2), lambda i: i % 3 > 0
    m, out = run(spark, rows, learning, share=64, classes=5)
    counts = Counter(t for i, x in rows if learning(i) for t in split(x))
    assert len(m.units.core) < len(counts)
    for i, s in out.select("doc_id", "score").collect():
        assert s == pytest.approx(plain_log(m, counts, rows[i][1]), rel=1e-9)
    steps, emits = 10**m.steps, 10**m.emits
    assert np.allclose(steps.sum(1), 1) and np.allclose(np.bincount(m.classes, emits, len(steps)), 1)
    other, again = run(spark, rows[::-1], learning, share=64, classes=5)
    assert sorted((r.doc_id, round(r.score, 9)) for r in again.collect()) == sorted((r.doc_id, round(r.score, 9)) for r in out.collect())


def test_a_move_raises_the_value_by_its_gain():
    r = np.random.default_rng(1)
    n, k = 12, 4
    pairs = r.integers(0, 9, (n, n))
    pairs += np.triu(pairs, 1).T - np.triu(pairs, 1).T
    # as many before as after, as in a ring of texts
    ring = r.integers(0, n, 4000)
    pairs = np.zeros((n, n))
    np.add.at(pairs, (ring, np.roll(ring, -1)), 1)
    classes = r.integers(0, k, n)
    table = lambda c: np.array([[pairs[np.ix_(c == a, c == b)].sum() for b in range(k)] for a in range(k)])
    matrix = table(classes)
    l = np.stack([np.bincount(classes, pairs[:, u], k) for u in range(n)])  # noqa: E741
    o = np.stack([np.bincount(classes, pairs[u], k) for u in range(n)])
    own, whole = np.diag(pairs).copy(), pairs.sum(0)
    l[np.arange(n), classes] -= own
    o[np.arange(n), classes] -= own
    g = brown_lm.gains(matrix, l, o, own, whole, classes, k)
    for u in range(n):
        for b in range(k):
            moved = classes.copy()
            moved[u] = b
            assert brown_lm.value(table(moved)) - brown_lm.value(matrix) == pytest.approx(g[u, b] - g[u, classes[u]], abs=1e-6)


def test_classes_follow_use_and_beat_the_base(spark):
    rows, learning = texts(600, 3), lambda i: i % 5 > 0
    m, out = run(spark, rows, learning, classes=8)
    u = lambda w: m.classes[int(m.units.of(*(x[:1] for x in brown_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[:2]))[0])]
    assert len({u(w) for w in ("cat", "dog", "bird", "fish")} & {u(w) for w in ("sees", "likes", "hunts")}) == 0
    held = out.where("doc_id % 5 = 0").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert held[1] > 0.8 * held[0]


def test_rounds_never_lower_the_value(spark):
    df = spark.createDataFrame(texts(200, 4), "doc_id long, text string")
    counted = {}
    keep = brown_lm.exchange
    try:
        brown_lm.exchange = lambda *a: counted.setdefault("x", keep(*a))
        brown_lm.learn(df, classes=6)
    finally:
        brown_lm.exchange = keep
    kept = counted["x"][2]
    assert len(kept) > 1 and kept == sorted(kept)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    m = brown_lm.learn(df.where("doc_id > 5"))
    out = {r.doc_id: r for r in brown_lm.score(df, m, ["doc_id"]).collect()}
    assert out[1].n_known == 0 and out[1].base_score == 0 and math.isfinite(out[1].score)
    assert brown_lm.score(df.where("doc_id > 5"), m, ["doc_id"]).count() == 0


def test_query(spark, sf):
    out = queries.op12_brown_lm(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    want = {i: w for (i, _), w in zip(rows, base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2))}
    assert len(out) == len(rows)
    for r in out.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()
