"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their ids, form blocks of equal number. By any time
t of the mix a source's target A(t) grows by its weight's share among the sources that have blocks
left; weights are exact fractions. A source runs dry when its target meets its last block, and from
that moment on the others share its weight. Block i (from 0) is released at floor(a) and due at
ceil(b), where A(a) = i and A(b) = i + 1; earliest-deadline-first meets every window, so that at any
slot each source is less than one block off its target. Targets add up to the slots, so that a
schedule exists for all weights and sizes. One task deals the slots; its memory grows with the
number of sources only. No row is dropped or repeated.

Edge cases: a null source is a source of its own; null and repeated ids keep their rows; a
weight that is missing counts as the least of the given ones; sources of weight 0 come, evenly, after
all others; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import written

PERIOD, BLOCK, BUCKETS = 1000, 16, 64
#: Up to so many rows the plan is broadcast.
SMALL_PLAN = 20_000


def schedule(shares: list[int]) -> list[list[int]]:
    """Slots of each share's blocks within one period of sum(shares) slots, earliest deadline first."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    waiting = [(0, s) for s, c in enumerate(shares) if c]  # releases
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


def _exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the ratio of the weights, which are read as the decimals that they show."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError(f"a negative weight: {weights}")
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def deal(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """source, block, slot, release and deadline of all blocks, slot by slot."""
    whole, start = _exact({s: weights[s] for s in blocks}), 0
    for tier in ({s: w for s, w in whole.items() if w}, {s: 1 for s, w in whole.items() if not w}):
        sized = {s: blocks[s] for s in tier if blocks[s]}
        yield from _dealt(sized, tier, start)
        start += sum(sized.values())


def _dealt(blocks: dict[str, int], weights: dict[str, int], start: int) -> Iterator[tuple[str, int, int, int, int]]:
    dry = sorted(blocks, key=lambda s: (Fraction(blocks[s], weights[s]), s))
    names, n, w = dry, [blocks[s] for s in dry], [weights[s] for s in dry]
    # while the first k sources are dry: their blocks, and the weights of the others
    gone, rest = [0, *accumulate(n)], [sum(w[k:]) for k in range(len(n) + 1)]
    phase, given = [0] * len(n), [0] * len(n)

    def at(s: int, i: int) -> tuple[int, int]:
        """Floor and ceiling of the time at which the target of s comes to i."""
        while i * w[phase[s]] > n[phase[s]] * w[s]:
            phase[s] += 1
        low, more = divmod(i * rest[phase[s]], w[s])
        return start + gone[phase[s]] + low, start + gone[phase[s]] + low + (more > 0)

    waiting: list[tuple[int, int]] = [(start, s) for s in range(len(n))]
    ready: list[tuple[int, int, int, int]] = []
    for t in range(start, start + gone[-1]):
        while waiting and waiting[0][0] <= t:
            release, s = heapq.heappop(waiting)
            after, due = at(s, given[s] + 1)
            heapq.heappush(ready, (due, s, release, after))
        due, s, release, after = heapq.heappop(ready)
        yield names[s], given[s], t, release, due
        given[s] += 1
        if given[s] < n[s]:
            heapq.heappush(waiting, (after, s))


def plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> DataFrame:
    """The table of `deal`, made by one task that hands on `period` slots at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                rows = deal(blocks, weights)
                while some := list(islice(rows, period)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)], ["_s", "_block", "_slot", "_release", "_deadline"])

    return spark.range(0, 1, 1, 1).mapInArrow(made, "_s string, _block long, _slot long, _release long, _deadline long")


def tempered(blocks: dict[str, int], power: float) -> dict[str, float]:
    return {s: max(n, 1) ** power for s, n in blocks.items()}


def _named(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, key: str = "doc_id", source: str = "source", block: int = BLOCK, period: int = PERIOD, prefix: str = "") -> DataFrame:
    """docs with block, slot, release, deadline (in slots) and place (within the block), each after `prefix`.

    Without weights, a source weighs its number of blocks to the power `power`. Slot and place
    give the order of the mix.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    sized = docs.select(_named(source).alias("_s"), F.pmod(h, F.lit(1 << 16)).alias("_fine"))
    n = docs.count()
    buckets = min(1 << 16, max(BUCKETS, 1 << (n >> 20).bit_length()))  # a bucket of a source holds about a million rows at most
    of = F.floor(F.col("_fine") * buckets / (1 << 16)).cast("int")
    counts = written(sized.groupBy("_s", of.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))
    totals = {r[0]: r[1] for r in counts.groupBy("_s").agg(F.sum("_n")).collect()}
    blocks = {s: -(-n // block) for s, n in totals.items()}
    named = tempered(blocks, power) if weights is None else {s: weights.get(s[1:] if s != "n" else None, min(weights.values())) for s in blocks}
    table = written(plan(docs.sparkSession, blocks, named, period))
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_s", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    columns = [F.col(f"`{c}`") for c in docs.columns if c not in {f"{prefix}{x}" for x in ("block", "slot", "release", "deadline", "place")}]
    held = docs.select(*columns, _named(source).alias("_s"), h.alias("_h"), F.pmod(h, F.lit(1 << 16)).alias("_fine")).withColumn("_bucket", of)
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_bucket").orderBy("_h", F.col(f"`{key}`"))) - 1)
    ranked = ranked.join(F.broadcast(first) if len(totals) * buckets <= SMALL_PLAN else first, ["_s", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block))
    p = F.broadcast(table) if sum(blocks.values()) <= SMALL_PLAN else table
    met = ranked.join(p, ["_s", "_block"])
    return met.select(
        *columns,
        F.col("_block").alias(f"{prefix}block"),
        F.col("_slot").alias(f"{prefix}slot"),
        F.col("_release").alias(f"{prefix}release"),
        F.col("_deadline").alias(f"{prefix}deadline"),
        (F.col("_rank") % block).cast("int").alias(f"{prefix}place"),
    )


def in_order(docs: DataFrame, numbered: str | None = None, **options) -> DataFrame:
    """The rows of docs in the order of the mix: ranges of slots, sorted; `numbered` names a column for each row's place in that order."""
    mixed = mix(docs, prefix="_mix_", **options)
    mixed = mixed.repartitionByRange("_mix_slot", "_mix_place").sortWithinPartitions("_mix_slot", "_mix_place")
    number = F.col("_mix_slot") * options.get("block", BLOCK) + F.col("_mix_place")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c != numbered], *([number.alias(numbered)] if numbered else []))
