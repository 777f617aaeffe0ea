"""Encoders, filters and readers on small literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixmill.functions import codec, filters
from helixmill.sources import genomic


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first().v


def test_symbols(spark):
    assert one(spark, codec.encode_text(F.col("s")), s="ACGTacgtN") == "ACGTACGTG"
    assert one(spark, codec.encode_reference(F.col("s")), s="ACNgtn") == "ACNGTG"
    assert one(spark, codec.reverse_complement(F.col("s")), s="AACTG") == "CAGTT"
    assert one(spark, codec.seed_code(F.col("s")), s="A" * 13 + "G" + "CC") == 3
    assert one(spark, codec.seed_code(F.col("s")), s="G" * 14) == 4**14 - 1
    assert one(spark, codec.seed_code(F.col("s")), s="A" * 13 + "N") == -1
    assert one(spark, codec.base_code(F.col("s")), s="T") == 2 and one(spark, codec.code_base(F.lit(3))) == "G"


def test_mismatches(spark):
    a = "ACTG" * 26
    for b, n in ((a, 0), ("C" + a[1:], 1), (a[:-1] + "A", 1), ("T" * 104, 78)):
        assert one(spark, codec.mismatches(F.col("a"), F.col("b")), a=a, b=b) == n


@pytest.mark.parametrize(("name", "n"), [("1", 1), ("chr22", 22), ("X", 23), ("chrY", 24), ("24", 24), ("25", None), ("chr", None), ("MT", None)])
def test_chromosomes(spark, name, n):
    assert one(spark, codec.chromosome(F.col("s")), s=name) == n


def test_numbers(spark):
    assert one(spark, codec.percentage(F.lit(3), F.lit(0))) == 100 and one(spark, codec.percentage(F.lit(2), F.lit(3))) == 66
    assert one(spark, codec.per(F.lit(1), F.lit(0))) == -1.0 and one(spark, codec.per(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, codec.homopolymer(F.col("s"), F.lit(12)), s="A" * 12 + "C") is True
    assert one(spark, codec.homopolymer(F.col("s"), F.lit(11)), s="A" * 12 + "C") is False
    assert [one(spark, codec.variant_class(F.lit(r), F.lit(a))) for r, a in (("A", "C"), ("AC", "A"), ("A", "AC"), ("AC", "GT"))] == ["SUB", "DEL", "INS", None]
    assert one(spark, codec.dinucleotide_repeat(F.lit("ACACACACACAC"))) is True
    assert one(spark, codec.elapsed(F.lit(90.0))) == "1.50 min"
    codec.register(spark)
    assert spark.sql("SELECT revcomp('AACTG') v, seed_code(repeat('G', 14)) c, seq_encode('acgtN') e").first() == ("CAGTT", 4**14 - 1, "01324")


def test_filter_tables(spark):
    assert filters.table(spark).count() == len(filters.SUB_120) + len(filters.INDEL_120)
    assert filters.table(spark, 150).where("kind = 'SUB' AND depth = 20").first().max_score == 29


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nACGTN\nacg\n>chr2\nTT\n\n")
    assert [tuple(r) for r in genomic.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_name").collect()] == [("chr1", "ACGTNACG"), ("chr2", "TT")]


def test_fastq(spark, tmp_path):
    r = "ACGT" * 30
    (tmp_path / "1.fq").write_text("".join(f"@r{i}\n{r}\n+\n@{'I' * 119}\n" for i in range(3)))
    (tmp_path / "2.fq").write_text("".join(f"@r{i}\n{r[::-1]}\n+\n{'I' * 120}\n" for i in range(2)) + "@r2\nACG\n+\nIII\n@r3\n" + r + "\n+\n" + "I" * 120 + "\n")
    assert [x.seq for x in genomic.read_fastq(spark, str(tmp_path / "1.fq")).orderBy("ord").collect()] == [r] * 3
    assert genomic.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).count() == 3
    assert {tuple(x) for x in genomic.validate_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect()} == {(2, "wrong length"), (3, "no mate")}
    assert genomic.input_info(spark, str(tmp_path / "1.fq")) == (120, 3)
    (tmp_path / "3.fa").write_text(f">>14\n{r[14:] + 'A' * 14}\n")
    assert genomic.read_fastq(spark, str(tmp_path / "3.fa")).first().seq == r[14:] + "A" * 14


def test_vcf_log_timeline_dump(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("#h\nchrX\t5\t.\tA\tG\t.\t.\tDEPTH=3;COV=0;SCORE=9\n7\t6\t.\tAC\tA\t.\t.\t.\n")
    rows = genomic.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()
    assert (rows[0].chr, rows[0].cls, rows[0].depth, rows[0].pct) == (23, "SUB", 3, 100) and (rows[1].cls, rows[1].depth) == ("DEL", None)
    (tmp_path / "a.log").write_text("rank 0 offset 0\nLOG DPU=1 REQ=5\nLOG DPU=1 TIME=7\nrank 2 offset 0\nLOG DPU=9 REQ=1\n")
    assert [(r["rank"], r.dpu, r.key, r.value) for r in genomic.read_log(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()] == [(0, 1, "REQ", 5), (0, 1, "TIME", 7), (2, 9, "REQ", 1)]
    (tmp_path / "t.csv").write_text("t," + ",".join(genomic.TIMELINE_STAGES) + "\n1.5," + "," * 2 + "3" + "," * 6 + "\n")
    assert [tuple(r) for r in genomic.read_timeline(spark, str(tmp_path / "t.csv")).collect()] == [(1.5, "accumulate_read", 3.0)]
    (tmp_path / "d.txt").write_text("x\nR: 1\nR: 2\ny\nR: 3\n")
    assert [r.list_no for r in genomic.read_dump(spark, str(tmp_path / "d.txt")).orderBy("line_no").collect()] == [0, 0, 1]
