"""Genome blocks, and files that the operators write, against brute force."""

from __future__ import annotations

import random

from helixmill.operators import simulate, store, variants


def test_around(spark):
    rng = random.Random(5)
    bases = {i: "".join(rng.choices("ACTG", k=n)) for i, n in enumerate((1, 63, 1024, 1025, 2300))} | {9: "", 10: "ACN’漢" * 500}
    genome = spark.createDataFrame(list(bases.items()), "seq_nr long, bases string")
    points = [(i, p) for i, b in bases.items() for p in (*range(0, len(b), 7), *range(len(b))[-3:], *range(1000, len(b))[:60])]
    bases[10] = "ACNNN" * 500
    for before, after in ((0, 118), (64, 130)):
        found = store.around(spark.createDataFrame(points, "seq_nr long, at long"), genome, "at", before, after, "site").collect()
        assert sorted(map(tuple, found)) == sorted((i, p, bases[i][max(p - before, 0) : p + after]) for i, p in points)


def test_write_vcf(spark, tmp_path):
    kept = spark.createDataFrame([(2, 5, "A", "G", 3, 4, 10), (1, 9, "AC", "A", 1, 2, 20)], "seq_nr long, pos long, ref string, alt string, depth long, cov long, mean long")
    variants.write_vcf(kept, str(tmp_path / "v"), "made")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[:2] == variants.header("made")[:2] and lines[4].startswith("#CHROM")
    assert lines[5:] == ["1\t9\t.\tAC\tA\t.\t.\tDEPTH=1;COV=2;SCORE=20", "2\t5\t.\tA\tG\t.\t.\tDEPTH=3;COV=4;SCORE=10"]


def test_write_fastq_and_split(spark, tmp_path):
    simulate.write_fastq(spark.createDataFrame([(2, "CA"), (1, "ACT")], "ord long, seq string"), str(tmp_path / "q"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "q")).collect()) == sorted(["@1", "ACT", "+", "III", "@2", "CA", "+", "II"])
    simulate.split_fasta(spark.createDataFrame([(1, "ACT"), (2, "GG")], "seq_nr long, bases string"), str(tmp_path / "f"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "f" / "seq_nr=2")).collect()} == {">2", "GG"}
