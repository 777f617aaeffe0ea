"""The seed index: positions, counts, skew-bounded chunks, balanced partitions, and its stored form."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import CHUNK, NEIGHBOUR, SEED, WORD
from ..sources import shared
from . import store

MAGIC, VERSION = "helixmill-index", 2
#: Positions of a sequence whose occurrences of a seed are ranked together.
RANKED = 1 << 16


def dimensions(genome: DataFrame, spread: int = 4096) -> DataFrame:
    """seq_nr, seq_len, pt_seq: lengths and offsets of the sequences in the whole; offsets come from sums of groups of sequences."""
    sized = genome.select("seq_nr", F.length("bases").cast("long").alias("seq_len")).withColumn("_group", F.floor(F.col("seq_nr") / spread))
    groups = sized.groupBy("_group").agg(F.sum("seq_len").alias("_sum"))
    before = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))  # a row a group
    inside = F.sum("seq_len").over(Window.partitionBy("_group").orderBy("seq_nr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("seq_len")
    return sized.withColumn("_inside", inside).join(before, "_group").select("seq_nr", "seq_len", (F.col("_before") + F.col("_inside")).alias("pt_seq"))


def _seeds(seq_nr: int, first: int, left: int, size: int, codes: np.ndarray, neighbours: bool = True, wanted: Broadcast | None = None, want: bool = True) -> tuple[np.ndarray, ...]:
    """The rows of a block: seeds and neighbours are rolled up by doubling, the first symbol in the highest bits; with `wanted` (bits of `marked`) only the seeds that are, or aren't, marked."""
    n = max(0, min(size, len(codes) - left - SEED - NEIGHBOUR + 1))
    known = np.concatenate([[0], np.cumsum(codes == 4)])
    at = left + np.flatnonzero(known[left + SEED : left + SEED + n] == known[left : left + n])
    r = {1: (codes & 3).astype(np.int64)}
    for k in (1, 2, 4, 8):
        r[2 * k] = (r[k][:-k] << (2 * k)) | r[k][k:]
    seed = (r[8][at] << 12) | (r[4][at + 8] << 4) | r[2][at + 12]
    if wanted is not None:
        here = (wanted.value[seed >> 3] >> (seed & 7).astype(np.uint8)) & 1 == want
        at, seed = at[here], seed[here]
    words = [(r[16][p] << 20) | (r[8][p + 16] << 4) | r[2][p + 24] for p in (at + SEED + k for k in range(0, NEIGHBOUR if neighbours else 0, WORD))]
    return (np.full(len(at), seq_nr, np.int64), first + (at - left).astype(np.int64), seed.astype(np.int32), *words)


def marked(seeds: DataFrame) -> Broadcast:
    """The seeds of a table as a bit each of all 4^14: 32 MB at any size of the table, which Spark's bitmaps gather."""
    at = F.col("seed").cast("long") + 1
    bits = np.zeros(1 << 2 * SEED - 3, np.uint8)
    for r in seeds.where("seed >= 0").groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        bits[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(bits)


#: Counted seeds go in parts by the high bits of an odd multiple, which spreads them; its inverse gives them back.
PARTS, SPREAD = 1 << 10, 0x9E3779B
#: Positions that a task sorts at a time; distinct seeds, and positions, that it adds up before it sends.
COUNTED, HELD, MOST = 1 << 23, 1 << 24, 1 << 30
_PART = (1 << 2 * SEED) // PARTS
_BACK = pow(SPREAD, -1, 1 << 2 * SEED)
_NONE = np.zeros(0, np.int32)


def _bytes(values: np.ndarray) -> bytes:
    """Numbers under 255 as a byte, others (all below 2^31) as 255 and four bytes behind all."""
    far = values >= 255
    return np.where(far, 255, values).astype(np.uint8).tobytes() + values[far].astype("<i4").tobytes()


def _numbers(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """n numbers of `_bytes`, and the bytes that they took."""
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    far = np.flatnonzero(out == 255)
    out[far] = np.frombuffer(raw[n : n + 4 * len(far)], "<i4")
    return out, n + 4 * len(far)


def _merged(k: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spread seeds in order and their counts, with those of more seeds added."""
    new, n = np.unique(((seeds.astype(np.int64) * SPREAD) & ((1 << 2 * SEED) - 1)).astype(np.int32), return_counts=True)
    if not len(k):
        return new, n.astype(np.int32)
    k, counts = np.concatenate([k, new]), np.concatenate([counts, n.astype(np.int32)])
    order = np.argsort(k, kind="stable")  # two runs in order
    k = k[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(counts[order], first, dtype=np.int32)


def _packed(k: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """part, n, packed: the distinct seeds of each part as steps from one to the next, and their counts."""
    ends = np.searchsorted(k, np.arange(PARTS + 1) * _PART)
    rows = [(p, int(b - a), _bytes(np.diff(k[a:b], prepend=p * _PART)) + _bytes(counts[a:b])) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "n", "packed"])


def _sent(seeds: np.ndarray) -> pa.RecordBatch:
    return _packed(*_merged(_NONE, _NONE, seeds))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> part, n, packed: a task adds up what it counts, and sends each seed once for every HELD distinct ones (or MOST positions)."""
    k, counts, held, n, total = _NONE, _NONE, [_NONE], 0, 0
    for batch in batches:
        for q, b, size, left, right, c, u in zip(*(batch.column(i).to_pylist() for i in range(len(store.NAMES))), strict=True):
            held.append(_seeds(q, b * store.BLOCK, left, size, store.unpack(c, left + size + right, u), False)[2])
            n += len(held[-1])
            if n >= COUNTED:
                k, counts = _merged(k, counts, np.concatenate(held))
                held, n, total = [_NONE], 0, total + n
                if len(k) >= HELD or total >= MOST:
                    yield _packed(k, counts)
                    k, counts, total = _NONE, _NONE, 0
    if n:
        k, counts = _merged(k, counts, np.concatenate(held))
    if len(k):
        yield _packed(k, counts)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, n, packed in order of the parts -> seed, n; a task holds the counts of one part."""
    part, sums = None, np.zeros(_PART, np.int64)

    def made() -> pa.RecordBatch:
        k = np.flatnonzero(sums)
        seed = ((k + part * _PART) * _BACK) & ((1 << 2 * SEED) - 1)
        return pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), pa.array(sums[k])], ["seed", "n"])

    for batch in batches:
        for p, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part:
                if part is not None:
                    yield made()
                part = p
                sums[:] = 0
            steps, read = _numbers(packed, n)
            sums[np.cumsum(steps)] += _numbers(packed[read:], n)[0]
    if part is not None:
        yield made()


def counts(genome: DataFrame) -> DataFrame:
    """seed, n: the histogram of a genome's positions. Each task sends its counts as sorted steps, about two bytes a distinct seed; neighbours are not made."""
    sent = store.cut(genome).mapInArrow(_counted, "part int, n int, packed binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, "seed int, n long")


WORDS = [f"w{k}" for k in range(NEIGHBOUR // WORD)]


def positions(genome: DataFrame) -> DataFrame:
    """seq_nr, seed_nr (0-based), seed (its number), w0 to w3 (its neighbour), of every position with a whole neighbour; seeds with unknown symbols are left out."""
    return store.scan(genome, _seeds, ", ".join(["seq_nr long", "seed_nr long", "seed int", *(f"{w} long" for w in WORDS)]))


def _nth(seed: np.ndarray) -> np.ndarray:
    """How often each seed has come before in its block."""
    order = np.argsort(seed, kind="stable")
    at, out = np.arange(len(seed)), np.empty(len(seed), np.int32)
    new = np.diff(seed[order], prepend=-1) != 0
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else 0
    return out


def marked_positions(genome: DataFrame, wanted: Broadcast, want: bool = True) -> DataFrame:
    """positions with nth (of its seed in the block), of the seeds that `wanted` marks, or of all others; no row is made of the rest."""

    def found(*block) -> tuple[np.ndarray, ...]:
        rows = _seeds(*block, wanted=wanted, want=want)
        return *rows, _nth(rows[2])

    return store.scan(genome, found, ", ".join(["seq_nr long", "seed_nr long", "seed int", *(f"{w} long" for w in WORDS), "nth int"]))


def homopolymers(genome: DataFrame, n: int = 12) -> DataFrame:
    """seq_nr, pos: 0-based positions whose `n` symbols before are all alike."""

    def found(seq_nr: int, first: int, left: int, size: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        turns = np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])])
        at = np.arange(max(left, n), left + size)
        at = at[turns[at - 1] == turns[at - n]]
        return np.full(len(at), seq_nr, np.int64), (first + at - left).astype(np.int64)

    return store.scan(genome, found, "seq_nr long, pos long")


def histogram(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


def chunked(seeds: DataFrame, size: int = CHUNK) -> DataFrame:
    """seeds with n, ord and chunk_id: no chunk of a seed holds over `size`; the first takes what equal others leave.

    Ranks come from counts per seed and stretch of a sequence, so that a common seed is ranked in many groups.
    """
    far = seeds.withColumn("_far", F.floor(F.col("seed_nr") / RANKED))
    ranked = far.withColumn("_rank", F.row_number().over(Window.partitionBy("seed", "seq_nr", "_far").orderBy("seed_nr")) - 1)
    per = ranked.groupBy("seed", "seq_nr", "_far").agg((F.max("_rank") + 1).alias("_c"))  # from the ranks, so that both sides share one exchange
    of_seed = Window.partitionBy("seed")
    before = per.select("seed", "seq_nr", "_far", F.sum("_c").over(of_seed).alias("n"), (F.sum("_c").over(of_seed.orderBy("seq_nr", "_far").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    ranked = ranked.join(before, ["seed", "seq_nr", "_far"])
    ordinal = F.col("_before") + F.col("_rank")
    return ranked.select(*seeds.columns, "n", ordinal.alias("ord"), _chunk(F.col("n"), ordinal, size).alias("chunk_id"))


def chunk_sizes(counts: DataFrame, size: int = CHUNK) -> DataFrame:
    """seed, chunk_id, nb_nbr, n of each chunk, from seed counts alone."""
    chunks = F.ceil(F.col("n") / size)
    each = F.ceil(F.col("n") / chunks)
    rows = counts.select("seed", "n", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("chunk_id"))
    return rows.select("seed", "chunk_id", F.when(F.col("chunk_id") == 0, F.col("n") - (chunks - 1) * each).otherwise(each).cast("long").alias("nb_nbr"), "n")


def loads(chunks: DataFrame, parts: int) -> DataFrame:
    """part_id, size and workload (neighbours times occurrences of the seed) of partitions by seed code and chunk."""
    part = F.pmod(F.col("seed") + F.col("chunk_id"), F.lit(parts))
    return chunks.groupBy(part.alias("part_id")).agg(F.sum("nb_nbr").alias("size"), F.sum(F.col("nb_nbr") * F.col("n")).alias("workload"))


def balanced(chunks: DataFrame, parts: int, buckets: int = 4096) -> DataFrame:
    """bucket, part_id: buckets of chunks go, heaviest first, to the partition with the least workload. The driver sees the buckets only."""
    spread = F.shiftright(F.col("seed").cast("long") * F.lit(2654435761), 16)  # multiplicative hash; chunks of a seed go to buckets in a row
    bucket = F.pmod(spread + F.col("chunk_id"), F.lit(buckets)).cast("int")
    weights = chunks.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("nb_nbr") * F.col("n")).alias("w")).collect()
    heap, out = [(0, p) for p in range(parts)], []
    for r in sorted(weights, key=lambda r: (-r.w, r.bucket)):
        load, p = heapq.heappop(heap)
        out.append((r.bucket, p))
        heapq.heappush(heap, (load + r.w, p))
    return chunks.sparkSession.createDataFrame(out, "bucket int, part_id int")


@dataclass
class Index:
    """Rows with seed, chunk_id, seq_nr, seed_nr and words; and the seeds of several chunks with their last."""

    rows: DataFrame
    common: DataFrame


@dataclass
class Used:
    """The positions of some seeds, as a table (with nth); those that have several chunks, with n and last; and the numbers of positions of these before each block."""

    rows: DataFrame
    common: DataFrame
    before: DataFrame


def block_of() -> Column:
    return F.floor(F.col("seed_nr") / store.BLOCK)


def _before(rows: DataFrame) -> DataFrame:
    """seed, seq_nr, _block, _before: positions of a seed before a block, from counts by block."""
    per = rows.groupBy("seed", "seq_nr", block_of().alias("_block")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("seed").orderBy("seq_nr", "_block").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("seed", "seq_nr", "_block", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"))


def used(genome: DataFrame, seeds: DataFrame, size: int = CHUNK) -> Used:
    """The positions of those seeds of a genome that are asked for, for one batch of reads; of no other seed is a row made."""
    here = shared.kept(marked_positions(genome, marked(seeds)))
    several = shared.kept(_several(histogram(here), size))
    return Used(here, several, _before(here.select("seed", "seq_nr", "seed_nr").join(several.select("seed"), "seed", "left_semi")))


def _several(counts: DataFrame, size: int) -> DataFrame:
    return counts.where(F.col("n") > size).select("seed", "n", (F.ceil(F.col("n") / size) - 1).cast("int").alias("last"))


def located(found: DataFrame, several: DataFrame, before: DataFrame, size: int = CHUNK) -> DataFrame:
    """found (seed, seq_nr, seed_nr, nth) with chunk_id instead of nth: as `chunked`, without moving the positions that are not found."""
    met = found.withColumn("_block", block_of()).join(several.select("seed", "n"), "seed", "left").join(before, ["seed", "seq_nr", "_block"], "left")
    return met.withColumn("chunk_id", F.when(F.col("n").isNull(), F.lit(0)).otherwise(_chunk(F.col("n"), F.col("_before") + F.col("nth"), size))).drop("n", "nth", "_before", "_block")


def _chunk(n: Column, ordinal: Column, size: int) -> Column:
    """No chunk of a seed holds over `size`; the first takes what equal others leave."""
    chunks = F.ceil(n / size)
    each = F.ceil(n / chunks)
    head = n - (chunks - 1) * each
    return F.when(ordinal < head, F.lit(0)).otherwise(1 + F.floor((ordinal - head) / each)).cast("int")


def common(counts: DataFrame, size: int = CHUNK) -> DataFrame:
    """seed, last: the seeds of several chunks, one in `size` positions at most."""
    return counts.where(F.col("n") > size).select("seed", (F.ceil(F.col("n") / size) - 1).cast("int").alias("last"))


ROW = ", ".join(["seed int", "chunk_id int", "seq_nr long", "seed_nr long", *(f"{w} long" for w in WORDS)])


def _table(path: str) -> str:
    return f"helixmill_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_index(genome: DataFrame, path: str, parts: int | None = None, size: int = CHUNK) -> None:
    """The index of a genome at a new path: Parquet, bucketed (as many buckets as the session has shuffle partitions, unless `parts` says else) and sorted by seed and chunk, so that reads are joined without moving it."""
    spark = genome.sparkSession
    if shared.exists(spark, path):
        raise FileExistsError(path)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = shared.kept(_several(counts(genome), size))
    often = marked(several)
    rare, many = (marked_positions(genome, often, want) for want in (False, True))
    ranked = located(many, several, _before(shared.kept(marked_positions(genome, often).select("seed", "seq_nr", "seed_nr"))), size)
    columns = ["seed", "chunk_id", "seq_nr", "seed_nr", *WORDS]
    rows = rare.withColumn("chunk_id", F.lit(0)).select(*columns).unionByName(ranked.select(*columns))
    placed = rows.repartition(parts, "seed", "chunk_id").sortWithinPartitions("seed", "chunk_id")
    name = _table(path)
    placed.write.bucketBy(parts, "seed", "chunk_id").sortBy("seed", "chunk_id").option("path", f"{path}/index").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    several.select("seed", "last").coalesce(1).write.parquet(f"{path}/common")
    meta = json.dumps({"magic": MAGIC, "version": VERSION, "seed": SEED, "neighbour": NEIGHBOUR, "parts": parts})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_index(spark: SparkSession, path: str, part_ids: list[int] | None = None) -> Index:
    """The stored index, or the files of some of its partitions alone; another version or other sizes are refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if (meta.get("magic"), meta["version"], meta["seed"], meta["neighbour"]) != (MAGIC, VERSION, SEED, NEIGHBOUR):
        raise ValueError(f"index of version {meta['version']} with seeds of {meta['seed']} and neighbours of {meta['neighbour']}")
    several = spark.read.schema("seed int, last int").parquet(f"{path}/common")
    if part_ids is not None:
        files = [f"{path}/index/*_{p:05d}.c*" for p in part_ids]  # the bucket is part of a file's name
        there = [f for f in files if _any(spark, f)]
        return Index(spark.read.schema(ROW).parquet(*there) if there else spark.createDataFrame([], ROW), several)
    name = _table(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ROW}) USING parquet CLUSTERED BY (seed, chunk_id) SORTED BY (seed, chunk_id) INTO {meta['parts']} BUCKETS LOCATION '{path}/index'")
    return Index(spark.table(name), several)


def _any(spark: SparkSession, pattern: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there))
