"""Run logs and timelines: sums, averages, islands, spans, drawings and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def log_sums(log: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """key, total, mean: sums of values, over the number of changes of the device in order of the log; `bucket` cuts that order."""
    marked = scans.along(log.select(*order, "dpu"), bucket, order, lags={"_last": F.struct("dpu")})
    runs = marked.agg(F.sum(F.when(F.col("_last.dpu").eqNullSafe(F.col("dpu")) & F.col("_last").isNotNull(), 0).otherwise(1)).alias("runs"))
    sums = log.groupBy("key").agg(F.sum("value").alias("total"))
    return sums.join(runs, F.lit(True)).select("key", "total", (F.col("total") / F.col("runs")).alias("mean"))


def per_device(log: DataFrame, order: list[str], last: tuple[str, ...] = ("TIME",)) -> DataFrame:
    """rank, dpu, key, value: the last value of some keys, sums of the others."""
    newest = F.max_by("value", F.struct(*order))
    return log.groupBy("rank", "dpu", "key").agg(F.when(F.col("key").isin(*last), newest).otherwise(F.sum("value")).alias("value"))


def per_rank(devices: DataFrame, how: str) -> DataFrame:
    """rank, key, value: MOY the whole average over the rank's devices, MAX the largest; ALL keeps each device, with dpu."""
    if how == "ALL":
        return devices.select("rank", "dpu", "key", "value")
    value = F.floor(F.sum("value") / F.count(F.lit(1))).cast("long") if how == "MOY" else F.max("value")
    return devices.groupBy("rank", "key").agg(value.alias("value"))


def write_csv(rows: DataFrame, keys: tuple[str, ...], names: list[str], path: str) -> None:
    """Logs as CSV: a line for each rank (and device), a column for each of the named keys, in order of the lines."""
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names])
    wide.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("header", True).mode("errorifexists").csv(path)


def running_mean(rows: DataFrame, by: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    out = scans.along(rows, bucket, order, keys=(by,), sums={"_sum": F.col(value), "_n": F.col(value).isNotNull().cast("long")})
    return out.withColumn("mean", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_sum", "_n")


def islands(rows: DataFrame, by: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """by, island, value, n: runs of equal values within each group. With a bucket, a group's rows are scanned in pieces; without one, a group is one task's."""
    if bucket is None:
        along = Window.partitionBy(by).orderBy(*order)
        new = F.when(F.lag(value).over(along).eqNullSafe(F.col(value)), 0).otherwise(1)
        numbered = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        marked = scans.along(rows.select(by, *order, value).withColumn("_near", bucket), F.col("_near"), order, keys=(by,), lags={"_last": F.struct(value)})
        new = F.when(F.col("_last").isNotNull() & F.col("_last")[value].eqNullSafe(F.col(value)), 0).otherwise(1)
        numbered = scans.along(marked.withColumn("_new", new), F.col("_near"), order, keys=(by,), sums={"island": F.col("_new")})
    return numbered.groupBy(by, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def spans(samples: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, start, end: of the samples of a key, odd ones open and the next close."""
    along = Window.partitionBy(*keys).orderBy(t, *[c for c in samples.columns if c not in (*keys, t)])
    pairs = samples.withColumn("_n", F.row_number().over(along)).withColumn("end", F.lead(t).over(along))
    return pairs.where((F.col("_n") % 2 == 1) & F.col("end").isNotNull()).select(*keys, F.col(t).alias("start"), "end")


def from_first(rows: DataFrame, t: str) -> DataFrame:
    """Times from the first of all."""
    return rows.join(rows.agg(F.min(t).alias("_t0")), F.lit(True)).withColumn(t, F.col(t) - F.col("_t0")).drop("_t0")


def stage_means(found: DataFrame, stage: str) -> DataFrame:
    return found.groupBy(stage).agg(F.avg(F.col("end") - F.col("start")).alias("mean"))


def svg_lines(found: DataFrame, stage: str, colours: dict[str, str], scale: float = 1.0) -> DataFrame:
    """line: one SVG line for each span, stages in rows."""
    names = sorted(colours)
    row = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(stage))
    colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(colours.items()) for x in kv]), F.col(stage)), F.lit("black"))
    return found.select(F.format_string('<line x1="%.2f" y1="%d" x2="%.2f" y2="%d" stroke="%s"/>', F.col("start") * scale, row * 10, F.col("end") * scale, row * 10, colour).alias("line"))


def diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as often as it lacks them, with side < or >."""
    return one.exceptAll(two).withColumn("side", F.lit("<")).unionByName(two.exceptAll(one).withColumn("side", F.lit(">")))


def result_offsets(results: DataFrame, part: str, spread: int = 4096) -> DataFrame:
    """part, n, offset: prefix sums of result counts, over sums of groups of partitions."""
    counts = results.groupBy(part).agg(F.count(F.lit(1)).alias("n")).withColumn("_g", F.floor(F.col(part) / spread))
    groups = counts.groupBy("_g").agg(F.sum("n").alias("_s"))
    before = groups.select("_g", (F.sum("_s").over(Window.orderBy("_g")) - F.col("_s")).alias("_b"))
    inside = F.sum("n").over(Window.partitionBy("_g").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("_i", inside).join(before, "_g").select(part, "n", (F.col("_b") + F.col("_i")).alias("offset"))
