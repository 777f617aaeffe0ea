"""The prefix trie against a plain construction."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from helixmill.llm import oracle, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        at = sorted(c for c in m if len(made[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.digest(prefix_trie.trie(df)[0]).collect()), key=str)


def conversations(n, seed, words=3, turns=12):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot", None]), r.choice([None, "", "é", *("word" * k for k in range(words))])) for c in range(n) for t in range(r.randrange(turns))]


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rows = conversations(60, seed)
    assert found(spark, rows) == plain(rows)


def test_copies_long_ones_and_negatives(spark):
    copied = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(10)]
    long = [(7, t, "user", str(t % 2)) for t in range(2600)]
    negative = [(-c, t, "bot", "x" * t) for c in range(1, 9) for t in range(3)]
    nulls = [(None, 1, "user", "none"), (3, None, None, None), (3, 0, "user", "zero")]
    rows = copied + negative + nulls
    assert found(spark, rows) == plain(rows)
    got = {r[1]: r for r in found(spark, rows + long) if r[0] == 7 and r[1] > 8}
    assert len(got) >= 2500 and all(r[3] == 1 and r[5] == 1 for r in got.values()) and got[max(got)][7] == hashlib.sha256(b"7").hexdigest()


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert found(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_texts_of_nodes(spark):
    rows = conversations(20, 5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    nodes, paths = prefix_trie.trie(df)
    out = prefix_trie.texts(nodes, paths, df).collect()
    assert len(out) == nodes.count() and all((r.text is None) == (r.depth == 0) for r in out)
    assert {r.text for r in out} <= {None, "", *(t or "" for *_, t in rows)}


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(oracle.ORACLE["op13_prefix_trie"])
    got = queries.op13_prefix_trie(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
