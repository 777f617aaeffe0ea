"""Readers in splits of bytes against plain reading."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import store, telemetry
from helixmill.sources import genomic


@pytest.fixture
def splits(spark):
    """Splits of about 700 bytes, so that records lie across them."""
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{k}", "700")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def reads(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("ACGT", k=120)) for _ in range(n)]


def test_lines_are_numbered_over_splits(spark, splits, tmp_path):
    text = [f"{'x' * (i % 90)}{i}" for i in range(700)]
    (tmp_path / "b.txt").write_text("\n".join(text[:500]) + "\n")
    (tmp_path / "c.txt").write_text("\n".join(text[500:]))
    got = genomic.lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == list(enumerate(text))


def test_fastq_over_splits(spark, splits, tmp_path):
    one, two = reads(60, 1), reads(57, 2)
    for name, rows in (("1.fq", one), ("2.fq", two)):
        (tmp_path / name).write_text("".join(f"@r{i}\n{s}\n+\n@{'I' * 119}\n" for i, s in enumerate(rows)))
    got = genomic.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).orderBy("pair_id").collect()
    assert [tuple(r) for r in got] == [(i, a, b) for i, (a, b) in enumerate(zip(one, two))]
    (tmp_path / "3.fa").write_text("".join(f">>{i % 3}\n{s}\n" for i, s in enumerate(one)))
    assert [r.seq for r in genomic.read_fastq(spark, str(tmp_path / "3.fa")).orderBy("ord").collect()] == [s[: 120 - i % 3] + "A" * (i % 3) for i, s in enumerate(one)]


def test_fasta_blocks_over_splits(spark, splits, tmp_path):
    r = random.Random(3)
    bases = {f"s{i}": "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=n)) for i, n in enumerate((1, 61, 1024, 3000, 4100))}
    wrap = lambda s, w: "\n".join(s[i : i + w] for i in range(0, len(s), w))
    (tmp_path / "g.fa").write_text("".join(f">{n} of the test\n{wrap(s, 61 if i % 2 else 5000)}\n\n" for i, (n, s) in enumerate(bases.items())))
    rows = genomic.read_fasta_lines(spark, str(tmp_path / "g.fa"))
    blocks = store.of_lines(rows)
    whole = genomic.read_fasta(spark, str(tmp_path / "g.fa"))
    names = {r.seq_name: r.seq_nr for r in rows.select("seq_name", "seq_nr").distinct().collect()}
    assert names == {n: i for i, n in enumerate(bases)}
    cut = store.cut(whole.select(F.regexp_extract("seq_name", r"(\d+)", 1).cast("long").alias("seq_nr"), "bases"))
    plain = lambda df: sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in row) for row in df.select(*store.NAMES).collect()), key=lambda t: t[:2])
    assert plain(blocks) == plain(cut)
    path = str(tmp_path / "store")
    store.write_genome(blocks, path)
    assert {r.seq_nr: r.seq_len for r in store.lengths(store.read_genome(spark, path)).collect()} == {i: len(s) for i, s in enumerate(bases.values())}


def test_log_csv_and_dump_lists(spark, tmp_path):
    (tmp_path / "d.txt").write_text("x\nR: 1\nR: 2\ny\nR: 3\n")
    genomic.write_dump_lists(genomic.read_dump(spark, str(tmp_path / "d.txt")), str(tmp_path / "lists"))
    assert [[r[0] for r in spark.read.text(f"{tmp_path}/lists/list_no={k}").collect()] for k in (0, 1)] == [["R: 1", "R: 2"], ["R: 3"]]
    rows = spark.createDataFrame([(0, 2, "REQ", 5), (0, 1, "REQ", 7), (1, 4, "TIME", 2)], "rank long, dpu long, key string, value long")
    telemetry.write_csv(telemetry.per_rank(rows, "ALL"), ("rank", "dpu"), ["REQ", "TIME"], str(tmp_path / "csv"))
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("rank", "dpu").collect()
    assert [tuple(r) for r in got] == [("0", "1", "7", None), ("0", "2", "5", None), ("1", "4", None, "2")]
