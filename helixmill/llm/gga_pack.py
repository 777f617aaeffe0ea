"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised once. What the packing search works on is the histogram of piece lengths:
pieces of one length are interchangeable, so a packing is a multiset of bins (tuples of lengths),
and its size is bounded by the capacity and not by the corpus. Each island is a Spark task that
evolves packings of the whole histogram; after each epoch the elites migrate. Crossover takes
well-filled bins of one parent whole, keeps of the other's bins those that its remaining pieces
still allow, and packs the displaced pieces best-fit, longest first. Pieces then take the places
of their length by rank; ranks come from counts per length and hash bucket.

Where the documents have an order, sequences follow it: ranges of SPAN places are packed each by
itself, a range an island's work in one task. In a range, pieces of one length take their places in
order, bins alike are spread over the range, and sequences are numbered by their first piece.

Edge cases: a null or empty text is one piece of the end token alone; repeated rows are packed
once each; an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _tokens
from ._spark import written

CAPACITY = 2048
END = 0
BUCKETS = 64
#: Places of an order to a range: a period of the mix.
SPAN = 16_000
Packing = dict[tuple[int, ...], int]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, its ids as little-endian unsigned 32-bit bytes if wanted, and its document's place in an order if named.

    Only documents of more than `capacity` ids are cut: the first piece takes what the full ones leave.
    """
    path = path or _tokens.default_path()
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    schema = f"key {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids + ", order long" * (order is not None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for r in range(batch.num_rows):
                found = np.append(_tokens.ids(path, batch.column(1)[r].as_py()), np.uint32(END))
                head = len(found) % capacity or capacity
                for k, hi in enumerate(range(head, len(found) + 1, capacity)):
                    lo = max(0, hi - capacity) if k else 0
                    data = found[lo:hi].astype("<u4").tobytes()
                    at.append(r)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        ids.append(data)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            if order is not None:
                columns.append(batch.column(2).take(pa.array(at, pa.int64())))
                names.append("order")
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = [] if order is None else [F.col(order).cast("long").alias("order")]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *placed).mapInArrow(cut, schema)


class Bins:
    """Open bins by room left, in groups of equal content."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], {}

    def add(self, bin_: tuple[int, ...], room: int, n: int) -> None:
        if n:
            if room not in self.by_room:
                insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append((bin_, n))

    def take(self, size: int):
        """A group with the least room for `size`, or None."""
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        bin_, n = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(i)
        return bin_, room, n

    def result(self) -> Packing:
        out: Packing = Counter()
        for groups in self.by_room.values():
            for bin_, n in groups:
                out[tuple(sorted(bin_, reverse=True))] += n
        return dict(out)


def best_fit(bins: Bins, sizes: list[tuple[int, int]]) -> Packing:
    """Pack (length, count) in the order given, each piece into the bin that it leaves the least room in."""
    for size, count in sizes:
        while count:
            bin_, room, n = bins.take(size) or ((), bins.capacity, -(-count // (bins.capacity // size)))
            each = room // size
            full = min(n, count // each)
            bins.add(bin_ + (size,) * each, room - each * size, full)
            count -= full * each
            left = n - full
            if left and count:
                some = min(count, each)
                bins.add(bin_ + (size,) * some, room - some * size, 1)
                count -= some
                left -= 1
            if bin_:
                bins.add(bin_, room, left)
    return bins.result()


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins are fitter; among equals, those with the fuller full bins."""
    n = sum(packing.values())
    return -n, sum(k * (sum(b) / capacity) ** 2 for b, k in packing.items()) / max(n, 1)


def cross(one: Packing, other: Packing, total: Counter, capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of `one`, the bins of `other` that the remaining pieces allow, the rest best-fitted."""
    left, bins = Counter(total), Bins(capacity)
    least = capacity - int(rng.integers(0, max(2, capacity // 256)))
    for b, n in sorted(one.items()):
        if sum(b) >= least and rng.random() < 0.7:
            _keep(bins, left, b, n, capacity)
    for b, n in sorted(other.items(), key=lambda x: (-sum(x[0]), x[0])):
        if sum(b) < capacity * 0.98 or rng.random() < 0.1:
            continue
        _keep(bins, left, b, n, capacity)
    return best_fit(bins, sorted(((s, n) for s, n in left.items() if n), reverse=True))


def _keep(bins: Bins, left: Counter, bin_: tuple[int, ...], n: int, capacity: int) -> None:
    need = Counter(bin_)
    n = min(n, *(left[s] // k for s, k in need.items()))
    if n > 0:
        for s, k in need.items():
            left[s] -= k * n
        bins.add(bin_, capacity - sum(bin_), n)


def evolve(total: Counter, elites: list[Packing], capacity: int, population: int, generations: int, seed: int) -> list[Packing]:
    """One island's epoch: its population, fittest first. It ends early once no packing can have fewer bins."""
    rng, order = np.random.default_rng(seed), sorted(total.items(), reverse=True)
    alive = list(elites) or [best_fit(Bins(capacity), order)]
    while len(alive) < population:
        shaken = sorted(order, key=lambda x: -x[0] * (1 + 0.15 * rng.random()))
        alive.append(best_fit(Bins(capacity), shaken))
    alive.sort(key=lambda p: fitness(p, capacity), reverse=True)
    least = lower_bound(total, capacity)
    for _ in range(generations):
        if sum(alive[0].values()) <= least:
            break
        a, b = rng.choice(max(2, population // 2)), rng.choice(population)
        child = cross(alive[a], alive[b], total, capacity, rng)
        alive[-1] = child if fitness(child, capacity) > fitness(alive[-1], capacity) else alive[-1]
        alive.sort(key=lambda p: fitness(p, capacity), reverse=True)
    return alive


def lower_bound(total: Counter, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by the pieces of over half a bin."""
    volume = -(-sum(s * n for s, n in total.items()) // capacity)
    return max(volume, sum(n for s, n in total.items() if 2 * s > capacity))


def search(spark, total: Counter, capacity: int = CAPACITY, islands: int = 6, epochs: int = 3, population: int = 6, generations: int = 8, seed: int = 1) -> Packing:
    """The fittest packing found. The driver sees the histogram and the elites, whose sizes the capacity bounds."""
    full = total.pop(capacity, 0) if capacity in total else 0
    if not total:
        return {(capacity,): full} if full else {}
    least, held = lower_bound(total, capacity), spark.sparkContext.broadcast(dict(total))
    elites: list[list[Packing]] = [[] for _ in range(islands)]
    best: Packing | None = None
    for epoch in range(epochs):
        if best and sum(best.values()) <= least:
            break
        rows = [(i, pickle.dumps(elites[i])) for i in range(islands)]

        def island(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    alive = evolve(Counter(held.value), pickle.loads(kept), capacity, population, generations, seed * 1000 + epoch * 100 + i)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(alive[:2])], pa.binary())], ["island", "elites"])

        found = spark.createDataFrame(rows, "island int, elites binary").repartition(islands).mapInArrow(island, "island int, elites binary").collect()
        alive = [pickle.loads(r[1]) for r in sorted(found, key=lambda r: r[0])]
        elites = [[*alive[i], alive[i - 1][0]] for i in range(islands)]  # a ring: each island's best goes to the next
        best = max(([best] if best else []) + [p[0] for p in alive], key=lambda p: fitness(p, capacity))
    if full:
        best = best | {(capacity,): full}
    return best


def places(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of its runs of places, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for bin_, n in sorted(packing.items(), reverse=True):
        offset = 0
        for size in bin_:
            runs.setdefault(size, []).append((ranks[size], sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, **search_options) -> DataFrame:
    """The rows of `cut` (see pieces; a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    spread = cut.withColumn("_bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    counts = written(spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")))
    total = Counter({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    shared = spark.sparkContext.broadcast(places(search(spark, total, capacity, **search_options)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    order = [F.col("key").asc_nulls_first(), "piece", "ids_crc32"]
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1).join(first, ["length", "_bucket"])
    columns = [F.col(f"`{c}`") for c in cut.columns]
    ready = ranked.select(*columns, (F.col("_rank") + F.col("_first")).alias("_rank"))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, names = cut.columns.index("length"), [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                here = length == size
                ranks, sequences, offsets = shared.value[int(size)]
                run = np.searchsorted(ranks, rank[here], "right") - 1
                sequence[here] = sequences[run] + rank[here] - ranks[run]
                offset[here] = offsets[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    return ready.mapInArrow(place, schema)


def fill(length: np.ndarray, capacity: int = CAPACITY, epochs: int = 3, population: int = 6, generations: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """sequence (from 0) and offset of each piece; the pieces are in order."""
    total = Counter(length.tolist())
    full = total.pop(capacity, 0)
    alive: list[Packing] = []
    for epoch in range(epochs if total else 0):
        alive = evolve(total, alive[:2], capacity, population, generations, seed * 1000 + epoch)
        if sum(alive[0].values()) <= lower_bound(total, capacity):
            break
    packing = (alive[0] if alive else {}) | ({(capacity,): full} if full else {})
    bins = [b for _, b in sorted(((2 * j + 1) / (2 * n), b) for b, n in packing.items() for j in range(n))]
    waiting = {s: iter(np.flatnonzero(length == s).tolist()) for s in set(length.tolist())}
    sequence, offset, first = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.full(len(bins), np.iinfo(np.int64).max)
    for k, b in enumerate(bins):
        at = 0
        for i in sorted(next(waiting[s]) for s in b):
            sequence[i], offset[i] = k, at
            first[k] = min(first[k], i)
            at += int(length[i])
    number = np.empty(len(bins), np.int64)
    number[np.argsort(first)] = np.arange(len(bins))
    return number[sequence], offset


def pack_in_order(cut: DataFrame, capacity: int = CAPACITY, span: int = SPAN, **search_options) -> DataFrame:
    """The rows of `cut` (see pieces, with an order) with sequence_id and offset; sequences follow the order up to ranges of `span` places."""
    schema = T.StructType([*cut.schema.fields, T.StructField("range", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = fill(table["length"].to_numpy(), capacity, **search_options)
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = written(cut.withColumn("range", F.expr(f"order div {span}")).groupBy("range").applyInArrow(one, schema))
    sizes = packed.groupBy("range").agg((F.max("sequence_id") + 1).alias("n")).orderBy("range").collect()  # a row for each range
    starts = list(zip([r[0] for r in sizes], accumulate([0] + [r[1] for r in sizes]), strict=False))
    first = cut.sparkSession.createDataFrame(starts, "range long, first long")
    return packed.join(F.broadcast(first), "range").withColumn("sequence_id", F.col("sequence_id") + F.col("first")).drop("range", "first")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids (bytes), n_ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), "n_ids")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", order: str | None = None, **options) -> DataFrame:
    """Tokenise and pack: key, piece, start, length, ids_crc32, sequence_id, offset. Sequences follow the column `order`, if named."""
    cut = written(pieces(docs, key, text, capacity=options.get("capacity", CAPACITY), order=order))
    packed = pack(cut, **options) if order is None else pack_in_order(cut, **options)
    return packed.select(F.col("key").alias(key), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
