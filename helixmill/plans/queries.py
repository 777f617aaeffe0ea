"""Registered queries of the mapping and variant-calling operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import evaluate, index, mapping, pairing, run, simulate, store, telemetry, variants
from ..sources import shared
from . import fixtures as fx

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def base_encode(spark: SparkSession, sf: str) -> DataFrame:
    return fx.genome(spark, sf).select("seq_nr", F.length("bases").cast("long").alias("seq_len"), F.md5("bases").alias("md5"))


@query
def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return fx.genome(spark, sf).select("seq_nr", F.md5(codec.reverse_complement(F.col("bases"))).alias("md5"))


@query
def seed_code(spark: SparkSession, sf: str) -> DataFrame:
    return fx.single_reads(spark, sf).select("num", codec.seed_code(F.col("seq")).alias("code"))


@query
def base_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    first = F.substring("seq", 1, 1)
    return fx.single_reads(spark, sf).select("num", codec.base_code(first).alias("code"), codec.code_base(codec.base_code(first)).alias("base"), codec.homopolymer(F.col("seq"), F.lit(60)).alias("homopolymer"), codec.dinucleotide_repeat(F.substring("seq", 1, 12)).alias("weak"))


@query
def genome_dim(spark: SparkSession, sf: str) -> DataFrame:
    return index.dimensions(fx.genome(spark, sf))


@query
def genome_access(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence in windows of 700 symbols, from a stored genome."""
    path = shared.fresh(spark, "genome")
    store.write_genome(fx.genome(spark, sf), path)
    blocks = store.read_genome(spark, path)
    starts = store.lengths(blocks).select("seq_nr", F.explode(F.sequence(F.lit(1).cast("long"), F.col("seq_len"), F.lit(700).cast("long"))).alias("first"))
    found = store.bases_at(blocks, starts.withColumn("last", F.col("first") + 699))
    return found.select("seq_nr", "first", F.md5("found").alias("md5"))


@query
def seed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    counts = index.counts(fx.blocks(spark, sf))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("seeds"))


@query
def seed_top(spark: SparkSession, sf: str) -> DataFrame:
    counts = index.counts(fx.blocks(spark, sf))
    return counts.withColumn("seed", store.text_of(F.col("seed"), codec.SEED)).orderBy(F.desc("n"), "seed").limit(100)


@query
def seed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    sizes = index.chunk_sizes(index.counts(fx.blocks(spark, sf)))
    return sizes.where(F.col("n") > codec.CHUNK).select(store.text_of(F.col("seed"), codec.SEED).alias("seed"), "chunk_id", "nb_nbr", "n")


@query
def partition_balance(spark: SparkSession, sf: str) -> DataFrame:
    return index.loads(index.chunk_sizes(index.counts(fx.blocks(spark, sf))), 128)


@query
def partition_lpt(spark: SparkSession, sf: str) -> DataFrame:
    chunks = index.chunk_sizes(index.counts(fx.blocks(spark, sf)))
    return index.balanced(chunks, 128)


@query
def seed_join(spark: SparkSession, sf: str) -> DataFrame:
    found = mapping.candidates(mapping.probes(fx.single_reads(spark, sf)), fx.blocks(spark, sf))
    return found.select("num", "seq_nr", "seed_nr", "chunk_id")


@query
def best_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = mapping.hits(mapping.probes(fx.single_reads(spark, sf)), fx.blocks(spark, sf), gaps=False)
    return mapping.best(found).select("num", "seq_nr", "seed_nr", "chunk_id", "score")


@query
def align_score(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.each_score(fx.paired_reads(spark, sf), fx.blocks(spark, sf))


@query
def oriented_reads(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.orient(fx.paired_reads(spark, sf)).select("num", "pair_id", F.col("type").cast("int").alias("type"), "seq")


@query
def zip_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.paired_reads(spark, sf)
    one, two = pairs.select("pair_id", "seq1"), pairs.where("pair_id % 3 != 0").select("pair_id", "seq2")
    return one.join(two, "pair_id")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.each_hit(fx.paired_reads(spark, sf), fx.blocks(spark, sf), gaps=False)


def _alike(spark: SparkSession, sf: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hits of distinct reads, and which read each is."""
    return mapping.distinct_hits(fx.paired_reads(spark, sf), fx.blocks(spark, sf), gaps=False, exact=exact)


@query
def index_hits(spark: SparkSession, sf: str) -> DataFrame:
    """pair_hits by a stored index."""
    path = shared.fresh(spark, "index")
    index.write_index(fx.blocks(spark, sf), path)
    found = mapping.map_reads(fx.paired_reads(spark, sf), index.read_index(spark, path), gaps=False)
    return found.select("num", "seq_nr", "seed_nr", "chunk_id", "score")


PAIR = pairing.PAIR


@query
def pair_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("num", "seq_nr", "seed_nr", "chunk_id", "score")


@query
def pair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.each_candidate(*_alike(spark, sf))


@query
def best_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.each_best(*_alike(spark, sf))


@query
def tie_break(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.choose_alike(*_alike(spark, sf)).select(*PAIR)


def _unmapped(spark: SparkSession, sf: str) -> DataFrame:
    hits, members = _alike(spark, sf, exact=True)
    return pairing.unmapped(pairing.with_hits(hits, members), pairing.paired_alike(hits.where("seq_nr IS NOT NULL"), members, same_sequence=True))


@query
def unmapped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _unmapped(spark, sf)


@query
def mapping_rate(spark: SparkSession, sf: str) -> DataFrame:
    hits, members = _alike(spark, sf)
    return pairing.mapping_rate(fx.paired_reads(spark, sf), pairing.with_hits(hits, members), pairing.paired_alike(hits, members))


@query
def unmapped_fasta(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.paired_reads(spark, sf)
    return pairing.unmapped_fasta(pairs, _unmapped(spark, sf)).select("pair_id", F.col("mate").cast("int").alias("mate"), "header", "seq")


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.paired_reads(spark, sf)
    return pairs.select(F.col("pair_id").alias("seq_nr"), F.explode(F.array(F.col("start"), F.col("start") + 229)).alias("pos"))


@query
def coverage_rle(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.coverage(pairing.starts_of(pairing.choose_alike(*_alike(spark, sf))))


@query
def coverage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    starts = _starts(spark, sf)
    points = fx.truth(spark, sf).select(F.col("chr").alias("seq_nr"), "pos")
    return pairing.coverage_at(points, pairing.coverage(starts)).select("seq_nr", "pos", "cov")


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return variants.mates(pairing.choose_alike(*_alike(spark, sf)), mapping.orient(fx.paired_reads(spark, sf)))


def _snv(spark: SparkSession, sf: str) -> DataFrame:
    return variants.aggregate(variants.call_substitutions(_placed(spark, sf), fx.blocks(spark, sf)))


@query
def snv_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _snv(spark, sf).select("seq_nr", "pos", "ref", "alt", "depth", "score")


@query
def indel_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Called with gaps, from reads that lack one to five of the symbols after the seed."""
    gapped = fx.gapped_reads(spark, sf)
    chosen = pairing.choose_alike(*mapping.distinct_hits(gapped, fx.blocks(spark, sf)))
    placed = variants.mates(chosen, mapping.orient(gapped))
    return variants.aggregate(variants.call_variants(placed, fx.blocks(spark, sf)))


@query
def reads_to_vcf(spark: SparkSession, sf: str) -> DataFrame:
    """FASTA and FASTQ files of the tables, through a stored genome and index, to the lines of a VCF: substitutions, unfiltered."""
    work = shared.fresh(spark, "run")
    g, pairs = fx.genome(spark, sf), fx.paired_reads(spark, sf)
    lines = g.select("seq_nr", F.posexplode(F.array(F.concat(F.lit(">"), F.col("seq_nr").cast("string")), "bases")).alias("k", "line"))
    lines.repartitionByRange("seq_nr").sortWithinPartitions("seq_nr", "k").select("line").write.text(f"{work}/fasta")
    for i in (1, 2):
        simulate.write_fastq(pairs.select(F.col("pair_id").alias("ord"), F.col(f"seq{i}").alias("seq")), f"{work}/fastq{i}")
    run.reads_to_vcf(spark, f"{work}/fasta", f"{work}/fastq1", f"{work}/fastq2", f"{work}/store", f"{work}/vcf", gaps=False, no_filter=True)
    return spark.read.text(f"{work}/vcf").where(~F.startswith(F.col("value"), F.lit("#"))).withColumnRenamed("value", "line")


def _made(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as variants with depths, coverages and scores of all sizes."""
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    ref, alt = F.substring(F.lit("ACTGAC"), 1, 1), F.lit("G")
    long = F.when(k % 5 == 0, F.lit("ACT")).otherwise(ref)
    other = F.when(k % 7 == 0, F.lit("AG")).otherwise(alt)
    return o.select((k % 97).alias("seq_nr"), (k * 13 % 900).alias("pos"), long.alias("ref"), other.alias("alt"), (1 + k % 25).alias("depth"), ((1 + k % 25) * (k * 7 % 41)).alias("score"), (k * 3 % 60).alias("cov"))


@query
def variant_filter(spark: SparkSession, sf: str) -> DataFrame:
    return variants.filter_variants(_made(spark, sf), fx.genome(spark, sf)).select("seq_nr", "pos", "ref", "alt", "depth", "cov", "pct", "mean")


@query
def homopolymer_del(spark: SparkSession, sf: str) -> DataFrame:
    return index.homopolymers(fx.genome(spark, sf)).groupBy("seq_nr").agg(F.count(F.lit(1)).alias("n"))


@query
def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = variants.filter_variants(_made(spark, sf), fx.genome(spark, sf))
    return variants.vcf_lines(kept).select("line")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    calls = _snv(spark, sf).withColumnRenamed("seq_nr", "chr")
    return evaluate.compare(evaluate.classified(calls), fx.truth(spark, sf))


@query
def vcf_eval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(_compared(spark, sf)).select("cls", "tp", "fp", "fn", F.round("tp_pct", 6).alias("tp_pct"), F.round("cm_pct", 6).alias("cm_pct"))


@query
def variant_class(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.classified(_made(spark, sf)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gate(evaluate.report(_compared(spark, sf)))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    m = _made(spark, sf)
    pct = codec.percentage(F.col("depth"), F.col("cov"))
    rated = m.select(F.when((F.col("pos") + F.col("score")) % 3 == 0, "FP").otherwise("TP").alias("status"), "depth", pct.alias("pct"), F.floor(F.col("score") / F.col("depth")).cast("long").alias("score"))
    return evaluate.histogram(rated)


@query
def filter_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query
def marginal_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.marginals(_counts(spark, sf))


@query
def filter_grid(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.grid(_counts(spark, sf))


@query
def best_filter(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.tune(_counts(spark, sf), evaluate.POWERS)


@query
def tuned_totals(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return evaluate.tuned_totals(counts, evaluate.tune(counts, evaluate.POWERS))


def _hour():
    """A stretch of the log's order."""
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)


@query
def log_sum(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.log_sums(fx.log(spark, sf), ["ts", "line_no"], _hour()).select("key", "total", F.round("mean", 9).alias("mean"))


@query
def log_devices(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.per_device(fx.log(spark, sf), ["ts", "line_no"], last=("click",))


@query
def log_rank_avg(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.per_rank(telemetry.per_device(fx.log(spark, sf), ["ts", "line_no"], last=("click",)), "MOY")


@query
def log_rank_max(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.per_rank(telemetry.per_device(fx.log(spark, sf), ["ts", "line_no"], last=("click",)), "MAX")


@query
def log_rank_all(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.per_rank(telemetry.per_device(fx.log(spark, sf), ["ts", "line_no"], last=("click",)), "ALL")


@query
def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.running_mean(fx.log(spark, sf), "dpu", ["ts", "line_no"], "value", _hour()).select("line_no", F.round("mean", 9).alias("mean"))


@query
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.islands(fx.log(spark, sf), "dpu", ["ts", "line_no"], "key")


@query
def stage_spans(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.log(spark, sf).select("dpu", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "line_no")
    return telemetry.spans(samples, ["dpu", "key"], "t").select("dpu", "key", "start", "end")


@query
def stage_means(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.log(spark, sf).select("dpu", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "line_no")
    return telemetry.stage_means(telemetry.spans(samples, ["dpu", "key"], "t"), "key").select("key", F.round("mean", 3).alias("mean"))


@query
def variant_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = _made(spark, sf).where(F.col("pos") > 0).withColumn("alts", F.concat_ws(",", F.lit("ACTGACTG"), "alt"))
    return simulate.select_variants(rows.select("seq_nr", "pos", "ref", "alts").distinct(), fx.genome(spark, sf))


@query
def dump_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    one, two = c.where("c_custkey % 10 != 3").select("c_nationkey", "c_mktsegment"), c.where("c_custkey % 10 != 4").select("c_nationkey", "c_mktsegment")
    return telemetry.diff(one, two)


@query
def interleave(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.paired_reads(spark, sf)
    one, two = pairs.select(F.col("pair_id").alias("ord"), F.col("seq1").alias("seq")), pairs.select(F.col("pair_id").alias("ord"), F.col("seq2").alias("seq"))
    return simulate.interleave(one, two, "ord").select("ord", "seq", "origin")


@query
def sort_results(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("num", "score", "seq_nr", "seed_nr").orderBy("num", "score", "seq_nr", "seed_nr")


@query
def result_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.result_offsets(fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("part")), "part")


@query
def simulated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    made = simulate.simulate_pairs(fx.genome(spark, sf), step=100)
    return made.groupBy("seq_nr").agg(F.count(F.lit(1)).alias("n"))
