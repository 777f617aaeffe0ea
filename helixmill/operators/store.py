"""The genome as a store of packed blocks: two bits a symbol, with overlap, read by sequence and block.

A block holds BLOCK symbols of a sequence, BEFORE of those before and AFTER of those after it, so that
every window that mapping and calling need lies in the block of its position, and no row carries a whole
sequence. Cutting is linear in a sequence: each symbol is packed a little over once, from a byte view.
Symbols outside ACTG are packed as A and marked in a bit set that most blocks lack.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.codec import SYMBOLS
from ..sources import shared

MAGIC, VERSION = "helixmill-genome", 1
BLOCK, BEFORE, AFTER = 1024, 64, 192
SCHEMA = "seq_nr long, block long, size int, left int, right int, codes binary, unknown binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Codes by byte, unknown as 4; symbols by code; the four codes of a packed byte, the first in the low bits.
CODES = np.full(256, 4, np.uint8)
CODES[[ord(c) for c in SYMBOLS]] = range(4)
LETTERS = np.frombuffer(f"{SYMBOLS}N".encode(), np.uint8)
FOUR = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)


def pack(codes: np.ndarray) -> bytes:
    c = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    c[: len(codes)] = codes & 3
    c = c.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def unpack(codes: bytes, n: int, unknown: bytes | None = None) -> np.ndarray:
    """The codes of a block, unknown ones 4."""
    out = FOUR[np.frombuffer(codes, np.uint8)].reshape(-1)[:n]
    if unknown:
        out = np.where(np.unpackbits(np.frombuffer(unknown, np.uint8), count=n).astype(bool), 4, out)
    return out


def _of_bases(bases: str) -> np.ndarray:
    return CODES[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]


def _of_text(text: str) -> np.ndarray:
    """The codes of any text, as `codec.encode_text` has its symbols."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where((points > 0) & (points < 256), (points >> 1) & 3, 4).astype(np.uint8)


def _rows(batches: Iterator[pa.RecordBatch], coded: Callable[[str], np.ndarray] = _of_bases) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)
        rows.clear()
        return out

    for batch in batches:
        for seq_nr, bases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = coded(bases or "")
            for block in range(-(-len(codes) // BLOCK)):
                first, end = block * BLOCK, min(len(codes), (block + 1) * BLOCK)
                lo, hi = max(0, first - BEFORE), min(len(codes), end + AFTER)
                piece = codes[lo:hi]
                lost = piece == 4
                rows.append((seq_nr, block, end - first, first - lo, hi - end, pack(piece), np.packbits(lost).tobytes() if lost.any() else None))
                if len(rows) >= 2048:
                    yield made()
    yield made()


def cut(genome: DataFrame) -> DataFrame:
    """The blocks of sequences (seq_nr, bases); blocks are spread, since one sequence or small file is one task. Blocks stay as they are."""
    if "codes" in genome.columns:
        return genome.select(*NAMES)
    spread = 2 * genome.sparkSession.sparkContext.defaultParallelism
    return genome.select("seq_nr", "bases").mapInArrow(_rows, SCHEMA).repartition(spread, "seq_nr", "block")


def of_texts(texts: DataFrame) -> DataFrame:
    """The blocks of texts (seq_nr, text), encoded as they are cut; they stay in the tasks of their texts."""
    return texts.select("seq_nr", "text").mapInArrow(lambda batches: _rows(batches, _of_text), SCHEMA)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq_nr, at, bases -> the parts of each line that a block holds, by block."""
    for batch in batches:
        rows = []
        for seq_nr, at, bases in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = bases.encode("latin-1", "replace")
            for block in range(max(0, (at - AFTER) // BLOCK), (at + len(raw) - 1 + BEFORE) // BLOCK + 1):
                lo, hi = max(at, block * BLOCK - BEFORE), min(at + len(raw), (block + 1) * BLOCK + AFTER)
                if hi > lo:
                    rows.append((seq_nr, block, lo, raw[lo - at : hi - at]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["seq_nr", "block", "at", "piece"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq_nr, block, its pieces in order -> blocks; those with overlap alone go."""
    for batch in batches:
        rows = []
        for seq_nr, block, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            codes = CODES[np.frombuffer(b"".join(p["piece"] for p in parts), np.uint8)]
            left, own = block * BLOCK - parts[0]["at"], min(BLOCK, parts[0]["at"] + len(codes) - block * BLOCK)
            if own > 0:
                lost = codes == 4
                rows.append((seq_nr, block, own, left, len(codes) - left - own, pack(codes), np.packbits(lost).tobytes() if lost.any() else None))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def of_lines(lines: DataFrame) -> DataFrame:
    """The blocks of sequences that come in lines (seq_nr, at, bases), without a row that holds a sequence."""
    parts = lines.select("seq_nr", "at", "bases").mapInArrow(_pieces, "seq_nr long, block long, at long, piece binary")
    whole = parts.groupBy("seq_nr", "block").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))  # a block's symbols
    return whole.mapInArrow(_joined, SCHEMA)


def write_genome(genome: DataFrame, path: str) -> None:
    """A store of the sequences (or blocks) at a new path; what it holds is stated last, so that a broken write is no store."""
    spark = genome.sparkSession
    if shared.exists(spark, path):
        raise FileExistsError(path)
    cut(genome).sortWithinPartitions("seq_nr", "block").write.parquet(f"{path}/blocks")
    meta = json.dumps({"magic": MAGIC, "version": VERSION, "block": BLOCK, "before": BEFORE, "after": AFTER})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a store of this version and these sizes; others are refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    want = {"magic": MAGIC, "version": VERSION, "block": BLOCK, "before": BEFORE, "after": AFTER}
    if meta != want:
        raise ValueError(f"a genome store of {meta}, not of {want}")
    return spark.read.schema(SCHEMA).parquet(f"{path}/blocks")


def lengths(blocks: DataFrame) -> DataFrame:
    """seq_nr, seq_len, from the sizes of blocks alone."""
    return blocks.groupBy("seq_nr").agg(F.sum("size").cast("long").alias("seq_len"))


@F.arrow_udf(StringType())
def piece(codes: pa.Array, unknown: pa.Array, first: pa.Array, n: pa.Array) -> pa.Array:
    """n symbols from the symbol `first` on of packed blocks, a batch at a time."""
    at, n = first.to_numpy(zero_copy_only=False).astype(np.int64), n.to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(codes.to_pylist()), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(c) for c in codes.to_pylist()])])[:-1]
    ends = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(at, n)
    out = (data[np.repeat(starts, n) + (k >> 2)] >> (2 * (k & 3)).astype(np.uint8)) & 3
    for i in np.flatnonzero(~np.array(unknown.is_null())):
        lost = np.unpackbits(np.frombuffer(unknown[i].as_py(), np.uint8)).astype(bool)
        own = slice(ends[i], ends[i + 1])
        out[own][lost[k[own]]] = 4
    letters = LETTERS[out].tobytes()
    return pa.array([letters[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def around(points: DataFrame, genome: DataFrame, pos: str, before: int, after: int, name: str) -> DataFrame:
    """points (seq_nr, `pos` 0-based, inside its sequence) with the symbols from `before` before `pos` to `after` after it, cut off at the ends, as `name`."""
    if before > BEFORE or after > AFTER:
        raise ValueError(f"blocks hold {BEFORE} symbols before and {AFTER} after")
    blocks = cut(genome).select("seq_nr", F.col("block").alias("_block"), F.col("size").alias("_size"), F.col("left").alias("_left"), F.col("right").alias("_right"), F.col("codes").alias("_codes"), F.col("unknown").alias("_unknown"))
    met = points.withColumn("_block", F.floor(F.col(pos) / BLOCK).cast("long")).join(blocks, ["seq_nr", "_block"])
    here = F.col(pos) - F.col("_block") * BLOCK + F.col("_left")
    first = F.greatest(here - before, F.lit(0))
    last = F.least(here + after, F.col("_left") + F.col("_size") + F.col("_right"))
    inside = met.where(F.col(pos) >= 0).where(here < F.col("_left") + F.col("_size"))
    return inside.select(*points.columns, piece("_codes", "_unknown", first.cast("int"), (last - first).cast("int")).alias(name))


def bases_at(genome: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (seq_nr, first, last; 1-based, inclusive) with their bases, cut off at the ends, as `found`; of any length, from the blocks that hold them. Wanted rows that repeat count once; what lies outside is empty."""
    parts = wanted.withColumn("_block", F.explode(F.sequence(F.floor((F.greatest("first", F.lit(1)) - 1) / BLOCK), F.floor((F.greatest("last", "first", F.lit(1)) - 1) / BLOCK))))
    met = parts.join(cut(genome).withColumnRenamed("block", "_block"), ["seq_nr", "_block"], "left")
    begin = F.col("_block") * BLOCK
    lo, hi = F.greatest(F.col("first") - 1, begin), F.least(F.col("last").cast("long"), begin + F.col("size"))
    held = F.col("codes").isNotNull() & (hi > lo)
    one = F.when(held, piece(F.coalesce("codes", F.lit(b"")), "unknown", F.when(held, lo - begin + F.col("left")).otherwise(0).cast("int"), F.when(held, hi - lo).otherwise(0).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", one.alias("p")))), lambda x: x["p"]), "", "")
    return met.groupBy(*wanted.columns).agg(joined.alias("found"))


def scan(genome: DataFrame, found, schema: str) -> DataFrame:
    """Rows of found(seq_nr, first, left, size, codes) for each block: a tuple of arrays, of which the first block symbol is codes[left], at `first` of the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(NAMES))]
            held: list = []
            for i, (seq_nr, block, size, left, right, codes, unknown) in enumerate(zip(*columns, strict=True)):
                held.append(found(seq_nr, block * BLOCK, left, size, unpack(codes, left + size + right, unknown)))
                if len(held) >= 64 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held = []

    return cut(genome).mapInArrow(run, schema)


def text_of(code: Column, n: int) -> Column:
    """n symbols as text, from their number, the first symbol first."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), n, "0"), "0123", SYMBOLS)
