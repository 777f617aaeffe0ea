"""The driver's tables as sequences and reads: each text is encoded symbol by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import READ, encode_text, reverse_complement
from ..operators import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_nr, bases: a sequence for each document. Texts are spread before they are encoded, since one small file is one task; uses within a query share that exchange."""
    return _encoded(_texts(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of `genome`, without its sequences."""
    return store.of_texts(_texts(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_nr"), F.coalesce("text", F.lit("")).alias("text")).repartition(2 * spark.sparkContext.defaultParallelism, "seq_nr")


def _encoded(texts: DataFrame) -> DataFrame:
    return texts.select("seq_nr", encode_text(F.col("text")).alias("bases"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_nr, p (1-based), site: the 350 symbols from p on, of sequences of 700 symbols and more. Symbols are as many as characters, so that the text is cut before it is moved and encoded."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_nr"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") >= 700)
    at = texts.withColumn("p", (1 + (F.col("seq_nr") * 37) % (F.length("text") - 600)).cast("int"))
    spread = at.select("seq_nr", "p", F.substring("text", F.col("p"), F.lit(230 + READ)).alias("text")).repartition(2 * spark.sparkContext.defaultParallelism, "seq_nr")
    return spread.select("seq_nr", "p", encode_text(F.col("text")).alias("site"))


def single_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num, seq: the first 120 symbols of benchmark passages that have them."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("num"), F.substring(encode_text(F.col("text")), 1, READ).alias("seq"))
    return passages.where(F.length("seq") == READ)


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, start, seq1, seq2: a pair from each long document, with one substitution in the middle of the first mate."""
    at = _windows(spark, sf_dir)
    one = F.substring("site", 1, READ)
    planted = F.concat(F.substring(one, 1, 59), F.translate(F.substring(one, 60, 1), "ACTG", "CTGA"), F.substring(one, 61, 60))
    two = reverse_complement(F.substring("site", 231, READ))
    return at.select(F.col("seq_nr").alias("pair_id"), (F.col("p") - 1).cast("long").alias("start"), planted.alias("seq1"), two.alias("seq2"))


def gapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, seq1, seq2: the pairs without the substitution, whose first mates lack one to five of the symbols after the seed."""
    size = (1 + F.col("seq_nr") % 5).cast("int")
    gap = F.concat(F.substring("site", 1, 59), F.substring("site", F.lit(60) + size, F.lit(61)))
    return _windows(spark, sf_dir).select(F.col("seq_nr").alias("pair_id"), gap.alias("seq1"), reverse_complement(F.substring("site", 231, READ)).alias("seq2"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted variants: chr, pos, ref, alt, cls."""
    ref = F.substring("site", 60, 1)
    return _windows(spark, sf_dir).select(F.col("seq_nr").alias("chr"), (F.col("p") + 59).cast("long").alias("pos"), ref.alias("ref"), F.translate(ref, "ACTG", "CTGA").alias("alt"), F.lit("SUB").alias("cls"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: line_no, ts, rank, dpu, key, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("line_no"), "ts", (F.col("user_id") % 8).alias("rank"), F.col("user_id").alias("dpu"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("value"))
