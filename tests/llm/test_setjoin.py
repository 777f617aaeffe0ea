"""The n-gram join against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from helixmill.llm import setjoin


def shingles(text, width=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, num=90, den=100):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (k, x) in enumerate(sets):
        groups.setdefault(find(i), []).append(k)
    return {(k, len(x), min((g for g in groups[find(i)] if g is not None), default=None) if x else k) for i, (k, x) in enumerate(sets)}


def noisy(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 11, 25, 60, 150, 400]))] for _ in range(25)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            p = rng.randrange(len(words))
            words[p : p + 1] = rng.choice([[rng.choice(vocabulary)], [], [words[p], rng.choice(vocabulary)]])
            words = words or ["w"]
        rows.append((i * 3, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = noisy(seed) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one TWO"), (9006, "É é"), (9006, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.join(docs).collect()}
    assert got == brute(rows)


def test_chains_join_through_members_that_are_not_first(spark):
    words = [f"w{i}" for i in range(203)]
    rows = []
    for i in range(12):  # each links with the next, the ends are far apart
        rows.append((100 - i, " ".join(words[:i * 6] and [f"x{j}" for j in range(i * 6)] + words[i * 6 :] or words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.join(docs).collect()}
    assert got == brute(rows) and len({c for _, _, c in got}) == 1


@pytest.mark.parametrize("seed", range(2))
def test_all_linked_pairs(spark, seed):
    rows = noisy(seed, 160)
    of, pairs = setjoin.linked_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    sets, cls = {k: frozenset(shingles(t)) for k, t in rows}, {r.doc_id: r.cls for r in of.collect()}
    distinct = {cls[k]: s for k, s in sets.items()}
    assert len(distinct) == len(set(sets.values()))
    want = {(min(a, b), max(a, b)) for a, x in distinct.items() for b, y in distinct.items() if a < b and 100 * len(x & y) >= 90 * len(x | y)}
    got = [(min(r), max(r)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_first_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    rank = rng.integers(0, 9, 1 << setjoin.BIN_BITS).astype(np.uint8)
    for num in (80, 90):
        for size in [*range(1, 60), 100, 333, 1000]:
            x = setjoin.set_of(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            y = setjoin.set_of(np.concatenate([x[rng.integers(0, size // 10 + 1) :], rng.integers(0, 1 << 63, rng.integers(0, size // 8 + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= num * (len(x) + len(y) - common):
                first = [setjoin.ordered(s, rank)[: setjoin.prefix(len(s), num, 100)].tolist() for s in (x, y)]
                at = next(i for i, s in enumerate(first[0]) if s in first[1])
                i, j = at, first[1].index(first[0][at])
                assert (i + j + abs(len(x) - i - len(y) + j)) * (100 + num) <= (len(x) + len(y)) * (100 - num)


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (None, None, "q"), (4, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    kept = setjoin.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id != 2], key=str)
    assert setjoin.join(docs.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    t, near, u = "a b c d e f", "A b c d  e f", "quite another text"
    rows = [(3, t, 0), (7, t, 1), (7, u, 2), (8, "twice the same row", 3), (8, "twice the same row", 3), (9, "one id", 4), (9, "ONE id", 5), (None, u, 6), (None, "no id here", 7), (None, "no id here", 8), (5, "", 9), (5, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    kept = setjoin.keep_one(docs).collect()
    assert sorted(r.n for r in kept if r.n not in (4, 5, 7, 8)) == [0, 2, 3, 9, 9]
    assert sum(r.n in (4, 5) for r in kept) == 1 and sum(r.n in (7, 8) for r in kept) == 1
    assert [r.n for r in setjoin.keep_one(spark.createDataFrame([(2, near, 0), (1, t, 1)], docs.schema)).collect()] == [1]


def test_entries_probe_only_cells_that_their_list_fills(spark):
    state = setjoin.Join.__new__(setjoin.Join)
    state.num, state.den = 90, 100
    rows = [(1, 0, 1, 10, 10, 1000, 0), (1, 0, 1, 11, 11, 1005, 0), (1, 0, 1, 12, 12, 1000, 40), (2, 0, 1, 13, 13, 50, 0), (2, 0, 1, 14, 14, 500, 3)]
    told = spark.createDataFrame(rows, "list long, chunk int, chunks int, cls long, root long, n int, i int")
    celled = state.celled(told, False)
    assert {r.list: bin(r.cells & (1 << 64) - 1).count("1") for r in celled.collect()} == {1: 2, 2: 2}
    assert {tuple(r) for r in state.blocks(celled, False).collect()} == {(10, 11), (10, 12), (12, 11)}
