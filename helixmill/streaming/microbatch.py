"""Mapping as a stream of read files: each micro-batch is mapped and its variants go to a store; running totals are kept by streams over that store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import READ
from ..operators import mapping, pairing, variants

PAIRS = "pair_id long, seq1 string, seq2 string"


def call_pairs(pairs: DataFrame, genome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant calls, starts of placed reads) of one batch of pairs."""
    hits = mapping.map_reads(pairs, genome)
    chosen = pairing.choose(hits)
    return variants.call_variants(variants.mates(chosen, mapping.orient(pairs)), genome), pairing.starts_of(chosen)


def start(spark: SparkSession, folder: str, genome: DataFrame, store: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Map Parquet files of pairs as they come, `files` at a time. A batch that is run again replaces its own output."""

    def batch(pairs: DataFrame, batch_id: int) -> None:
        pairs = pairs.persist()
        calls, starts = call_pairs(pairs, genome)
        calls.write.mode("overwrite").parquet(f"{store}/calls/batch_id={batch_id}")
        starts.write.mode("overwrite").parquet(f"{store}/starts/batch_id={batch_id}")
        pairs.unpersist()

    stream = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DEPTHS = ["seq_nr", "pos", "ref", "alt"]
STEPS = ["seq_nr", "at"]


def accumulate(spark: SparkSession, store: str, checkpoint: str) -> list[StreamingQuery]:
    """Streams over what the batches wrote, that hold totals in Spark's state: depth and score of each variant, and the change of coverage at each position. Each run of them reads the new files alone and writes the totals that changed."""

    def changed(name: str):
        def batch(rows: DataFrame, batch_id: int) -> None:
            rows.write.mode("overwrite").parquet(f"{store}/{name}/version={batch_id}")

        return batch

    calls = spark.readStream.schema(f"{variants.CALLS}, batch_id long").parquet(f"{store}/calls")
    starts = spark.readStream.schema("pair_id long, seq_nr long, pos long, batch_id long").parquet(f"{store}/starts")
    depth = calls.groupBy(*DEPTHS).agg(F.count(F.lit(1)).alias("depth"), F.sum("score").alias("score"))
    ends = starts.select("seq_nr", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + READ).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("seq_nr", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    started = []
    for name, rows in (("depth", depth), ("steps", steps)):
        writer = rows.writeStream.outputMode("update").foreachBatch(changed(name)).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append(writer.trigger(availableNow=True).start())
    return started


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Variants of all batches that were accumulated so far, with coverage: of each total its last version."""

    def newest(name: str, keys: list[str]) -> DataFrame:
        rows = spark.read.parquet(f"{store}/{name}")
        values = [c for c in rows.columns if c not in (*keys, "version")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v")).select(*keys, "v.*")

    return pairing.coverage_at(newest("depth", DEPTHS), pairing.levels(newest("steps", STEPS).where("d != 0")))
