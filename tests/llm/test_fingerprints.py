"""Fingerprints against plain Python sets and a plain ordering."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from helixmill.llm import iblt_fingerprint as fp

PARAGRAPH = re.compile(r"(?:[^\n.!?]*[.!?]+[ ]?|[^\n.!?]+){1,3}")


def jaccard(a: str, b: str) -> float:
    x, y = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def check(docs, rows):
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: -r[0])
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, (k, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, edited)) < 1e-9 and abs(r.near_next - jaccard(text, after)) < 1e-9
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint


def test_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(1000, None), (1001, ""), (1002, ""), (1003, "\n...\n"), (5000, "😀 é. b! c? d\n" * 3 + "x"), (7, "a. b. c. d. e.") , (6000, ".".join(f"s{i} t" for i in range(9000)))]
    docs = docs.where("doc_id != 7").unionByName(spark.createDataFrame(extra, docs.schema))
    check(docs, fp.versions(docs))


def test_ranges_meet(spark, monkeypatch):
    docs = spark.createDataFrame([(i * i, f"text {i}. " * (i % 5)) for i in range(300)], "doc_id long, text string")
    got = {r.key: r.next for r in fp.in_id_order(docs, "doc_id", "text", per_range=16).collect()}
    assert got == {i * i: f"text {(i - 1) % 300}. " * ((i - 1) % 300 % 5) for i in range(300)}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "n"), (5, "a"), (5, "b"), (5, "a"), (4, "c")], "doc_id long, text string")
    rows = fp.in_id_order(docs, "doc_id", "text").collect()
    assert len(rows) == 5
    assert [r.next for r in rows if r.text == "c"] == ["n"] and [r.next for r in rows if r.text == "n"][0] in ("a", "b")
    assert fp.versions(docs).count() == 5
    alone = fp.versions(spark.createDataFrame([(1, "x")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert fp.versions(docs.limit(0)).count() == 0
    assert fp.versions(spark.createDataFrame([(None, "x")], "doc_id long, text string")).count() == 1


def test_peeling_retries(spark):
    pairs = spark.range(4).select("id", F.lit(0).alias("pair"), F.transform(F.sequence(F.lit(1), F.lit(400)), lambda x: F.xxhash64(x)).alias("one"), F.transform(F.sequence(F.lit(300), F.lit(900)), lambda x: F.xxhash64(x)).alias("other"))
    assert {r.differ for r in fp.differences(pairs, cells=4).collect()} == {299 + 500}


def test_retries_move_digests_once(spark, monkeypatch):
    """What failed is peeled again from the same table: no table of pairs is written, and in the ranges no digests move with the texts."""
    pairs = spark.range(4).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pair")).select("id", "pair", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: F.xxhash64(x)).alias("one"), F.transform(F.sequence(F.lit(1) + 20 * F.col("pair"), F.lit(40) + 20 * F.col("pair")), lambda x: F.xxhash64(x)).alias("other"))
    tables, write = [], fp.written
    monkeypatch.setattr(fp, "written", lambda df: (tables.append(df.columns), write(df))[1])
    assert {(r.pair, r.differ) for r in fp.differences(pairs, cells=4).collect() if r.differ} == {(1, 40)}
    assert len(tables) > 1 and all("one" not in columns for columns in tables)
    docs = spark.createDataFrame([(i, f"text {i}. ") for i in range(9)], "doc_id long, text string")
    plan = fp.in_id_order(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Repartition" in x)
    assert not any("regexp_extract_all" in x for x in plan[at:]) and any("regexp_extract_all" in x for x in plan[:at])
