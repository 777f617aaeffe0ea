"""Quality of calls against a truth set, the acceptance gate, and the tuning of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import per, variant_class

KEYS = ["cls", "chr", "pos", "ref", "alt"]
GATE = 98.0
#: The powers that the weight of true calls is tried with.
POWERS = [0.5, 0.8, 1, 1.2, 1.5, 1.8, 2, 2.5, 3, 3.5, 4, 5, 6, 7, 8]


def classified(rows: DataFrame) -> DataFrame:
    """Rows with their class; those of no class go."""
    return rows.withColumn("cls", variant_class(F.col("ref"), F.col("alt"))).where(F.col("cls").isNotNull())


def compare(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """KEYS, status: TP if in both, FP if only called, FN if only true."""
    c = calls.select(*KEYS).distinct().withColumn("called", F.lit(True))
    t = truth.select(*KEYS).distinct().withColumn("true", F.lit(True))
    both = c.join(t, KEYS, "full_outer")
    return both.select(*KEYS, F.when(F.col("called").isNull(), "FN").when(F.col("true").isNull(), "FP").otherwise("TP").alias("status"))


def report(compared: DataFrame) -> DataFrame:
    """cls, tp, fp, fn, tp_pct (of the calls), cm_pct (of the truth)."""
    n = {s: F.count_if(F.col("status") == s.upper()).alias(s) for s in ("tp", "fp", "fn")}
    rows = compared.groupBy("cls").agg(*n.values())
    return rows.select("*", per(F.col("tp"), F.col("tp") + F.col("fp")).alias("tp_pct"), per(F.col("tp"), F.col("tp") + F.col("fn")).alias("cm_pct"))


def gate(reported: DataFrame, least: float = GATE) -> DataFrame:
    return reported.select("cls", ((F.col("tp_pct") >= least) & (F.col("cm_pct") >= least)).alias("passed"))


def assert_quality(reported: DataFrame, least: float = GATE) -> None:
    failed = [r.cls for r in gate(reported, least).collect() if not r.passed]  # three classes
    if failed:
        raise AssertionError(f"under {least} %: {', '.join(sorted(failed))}")


def histogram(rated: DataFrame) -> DataFrame:
    """status, depth, pct, score, n: rated variants (status, depth, pct, score), clamped to 20, 99 and 40."""
    return rated.groupBy("status", F.least("depth", F.lit(20)).alias("depth"), F.least("pct", F.lit(99)).alias("pct"), F.least("score", F.lit(40)).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def marginals(counts: DataFrame) -> DataFrame:
    """dim, value, tp, fp and running sums, for depth, pct and score each."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("long").alias("value")) for d in ("depth", "pct", "score")])
    long = counts.select("status", "n", F.explode(dims).alias("d")).select("status", "n", "d.*")
    sums = long.groupBy("dim", "value").agg(*[F.sum(F.when(F.col("status") == s.upper(), F.col("n")).otherwise(0)).alias(s) for s in ("tp", "fp")])
    along = Window.partitionBy("dim").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("*", *[F.sum(s).over(along).alias(f"{s}_upto") for s in ("tp", "fp")])


def grid(counts: DataFrame) -> DataFrame:
    """depth, pct (1..99), score (10..40), tp, fp: those with at least that percentage and at most that score.

    The grid has 20 x 99 x 31 cells whatever the input.
    """
    spark = counts.sparkSession
    cells = spark.range(21).select(F.col("id").cast("int").alias("depth"), F.explode(F.sequence(F.lit(1), F.lit(99))).alias("pct")).select("*", F.explode(F.sequence(F.lit(10), F.lit(40))).alias("score"))
    held = counts.groupBy("depth", "pct", "score").agg(*[F.sum(F.when(F.col("status") == s.upper(), F.col("n")).otherwise(0)).alias(s) for s in ("tp", "fp")])
    dense = cells.join(held.select(F.col("depth").cast("int").alias("depth"), F.col("pct").cast("int").alias("pct"), F.col("score").cast("int").alias("score"), "tp", "fp"), ["depth", "pct", "score"], "left").na.fill(0, ["tp", "fp"])
    by_score = Window.partitionBy("depth", "pct").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    by_pct = Window.partitionBy("depth", "score").orderBy(F.desc("pct")).rowsBetween(Window.unboundedPreceding, 0)
    some = dense.select("depth", "pct", "score", *[F.sum(s).over(by_score).alias(s) for s in ("tp", "fp")])
    return some.select("depth", "pct", "score", *[F.sum(s).over(by_pct).alias(s) for s in ("tp", "fp")])


def tune(counts: DataFrame, powers: list[float]) -> DataFrame:
    """power, depth, pct, score, metric: per power and depth the filter of the best (tp/(tp+fp))^power tp/total; (100, 0) if none is good enough."""
    spark = counts.sparkSession
    total = counts.groupBy(F.col("depth").cast("int").alias("depth")).agg(F.sum(F.when(F.col("status") == "TP", F.col("n")).otherwise(0)).alias("total"))
    each = grid(counts).join(total, "depth")
    power = spark.createDataFrame([(float(p),) for p in powers], "power double")
    tried = each.join(F.broadcast(power))  # a few powers
    metric = F.when((F.col("tp") == 0) | (F.col("total") == 0), F.lit(0.0)).otherwise(F.pow(F.col("tp") / (F.col("tp") + F.col("fp")), F.col("power")) * F.col("tp") / F.col("total"))
    order = Window.partitionBy("power", "depth").orderBy(F.desc("metric"), "pct", F.desc("score"))
    first = tried.withColumn("metric", F.round(metric, 9)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    good = F.col("metric") >= F.pow(F.lit(0.5), "power") * 0.5
    return first.select("power", "depth", F.when(good, F.col("pct")).otherwise(100).alias("pct"), F.when(good, F.col("score")).otherwise(0).alias("score"), "metric")


def tuned_totals(counts: DataFrame, tuned: DataFrame) -> DataFrame:
    """power, tp, fp: what passes the filters that `tune` chose, over all depths; a depth without a good filter passes nothing."""
    held = tuned.join(grid(counts), ["depth", "pct", "score"], "left")
    return held.groupBy("power").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp")])
