"""Training-order materialisation: token sequences in keyed random order, in fixed-stride shards.

Each task concatenates its documents' ids, each followed by the end token, and cuts them to
sequences of one length; the last is padded with end tokens. Sequences are numbered by task, and
a keyed Feistel network with cycle-walking permutes the numbers: every sequence has its slot
without any table or sort. Slots go to range partitions, one to a shard, whose records all have
one stride: record r of shard s is slot s * records + r, at byte r * stride. A reader seeks to any
slot and goes on from there.

Edge cases: a null or empty text gives its end token; repeated and null ids keep their ids; an empty
table gives an empty result; the order is fixed by the key and by how the input is split to tasks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens
from ._bytes import U, mix
from ._spark import shared_dir, written

LENGTH, RECORDS, END, ROUNDS = 2048, 2048, 0, 6


def permuted(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked until back under n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))
    out = x.astype(U)
    todo = np.ones(len(out), bool)
    while todo.any():
        v = out[todo]
        left, right = v >> U(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << U(half)) | right
        todo &= out >= U(n)
    return out.astype(np.int64)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each sequence: part, number (in the part), n_ids (without padding), keys (of its documents), ids (little-endian unsigned 16-bit)."""
    path = path or _tokens.default_path()
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rest, owners = TaskContext.get().partitionId(), 0, np.zeros(0, "<u2"), []
        kind_of = None

        def made(full: list[tuple[int, list, bytes]]) -> pa.RecordBatch:
            nonlocal number
            number += len(full)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(full), pa.int32()), pa.array(range(number - len(full), number), pa.int64()), pa.array([f[0] for f in full], pa.int32()), pa.array([f[1] for f in full], pa.list_(kind_of)), pa.array([f[2] for f in full], pa.binary())],
                ["part", "number", "n_ids", "keys", "ids"],
            )

        for batch in batches:
            kind_of, full = batch.column(0).type, []
            for r in range(batch.num_rows):
                owners.append(batch.column(0)[r].as_py())
                found = _tokens.ids(path, batch.column(1)[r].as_py())
                if len(found) and found.max() >> 16:
                    raise ValueError("the vocabulary has ids over 16 bits")
                rest = np.concatenate([rest, found.astype("<u2"), np.array([END], "<u2")])
                while len(rest) >= length:
                    full.append((length, owners, rest[:length].tobytes()))
                    rest = rest[length:]
                    owners = owners[-1:] if len(rest) else []
                if len(full) >= 512:
                    yield made(full)
                    full = []
            if full:
                yield made(full)
        if len(rest):
            yield made([(len(rest), owners, np.pad(rest, (0, length - len(rest)), constant_values=END).tobytes())])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(stream, f"part int, number long, n_ids int, keys array<{kind}>, ids binary")


def materialise(made: DataFrame, seed: int, records: int = RECORDS) -> DataFrame:
    """The rows of a written table of sequences with slot, shard and record, each shard a partition in order of its records."""
    spark = made.sparkSession
    # one row for each task that made sequences
    sizes = made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    first = np.zeros(1 + max([r.part for r in sizes], default=0), np.int64)
    total = 0
    for r in sizes:
        first[r.part] = total
        total += r.n
    if not total:
        return made.select("*", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("int").alias("record"))
    shared = spark.sparkContext.broadcast(first)
    names = [*made.columns, "slot"]
    ddl = ", ".join(f"{n} {t}" for n, t in made.dtypes) + ", slot long"

    at = made.columns.index("ids") if "ids" in made.columns else None

    def coded(batch: pa.RecordBatch, code) -> list[pa.Array]:
        columns = batch.columns
        if at is not None:
            columns[at] = pa.array([code(x) for x in columns[at].to_pylist()], pa.binary())
        return columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the slot; ids cross the cluster compressed."""
        code = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            number = shared.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*coded(batch, code), pa.array(permuted(number, total, seed))], names=names)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(coded(batch, code), names=names)

    shard = F.expr(f"slot div {records}")
    placed = made.mapInArrow(place, ddl).repartitionById(-(-total // records), shard.cast("int")).sortWithinPartitions("slot")
    if at is not None:
        placed = placed.mapInArrow(expand, ddl)
    return placed.select("*", shard.alias("shard"), (F.col("slot") % records).cast("int").alias("record"))


def write_shards(placed: DataFrame, folder: str, stride: int = 2 * LENGTH) -> DataFrame:
    """Write shard-00000000.bin and so on under `folder`, a URI all executors reach; a row for each: shard, first_slot, records, crc32. A retried task replaces its file whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        store = at = out = None
        shard, crc, n, first = -1, 0, 0, 0
        task = TaskContext.get().taskAttemptId()

        def close():
            if out is not None:
                out.close()
                store.move(f"{at}/.{shard}-{task}", f"{at}/shard-{shard:08d}.bin")
                done.append((shard, first, n, crc))

        for batch in batches:
            for s, slot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != shard:
                    close()
                    store, at = fs.FileSystem.from_uri(folder)
                    store.create_dir(at)
                    shard, crc, n, first = s, 0, 0, slot
                    out = store.open_output_stream(f"{at}/.{shard}-{task}")
                if len(ids) != stride or slot != first + n:
                    raise ValueError(f"slot {slot}: a record of {len(ids)} bytes; {first + n} of {stride} was due")
                out.write(ids)
                crc, n = zlib.crc32(ids, crc), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], ["shard", "first_slot", "records", "crc32"])

    return placed.select("shard", "slot", "ids").mapInArrow(write, "shard long, first_slot long, records long, crc32 long")


def read_from(folder: str, slot: int, count: int, records: int = RECORDS, length: int = LENGTH) -> np.ndarray:
    """`count` sequences from a slot on, in order, by seeking."""
    store, at = fs.FileSystem.from_uri(folder)
    out = []
    while count > 0:
        with store.open_input_file(f"{at}/shard-{slot // records:08d}.bin") as f:
            f.seek(slot % records * 2 * length)
            data = np.frombuffer(f.read(min(count, records - slot % records) * 2 * length), "<u2").reshape(-1, length)
        if not len(data):
            break
        out.append(data)
        slot, count = slot + len(data), count - len(data)
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().replace("file:///", "file:/").replace("file:/", "file:///")


def materialise_documents(docs: DataFrame, seed: int = 20_240_229, key: str = "doc_id", text: str = "text", records: int = RECORDS, folder: str | None = None) -> DataFrame:
    """Tokenise, place and write the shards: slot, shard, record, byte offset, n_ids, ids_crc32, documents, ids, and the shard's path and crc32.

    Shards go to `folder`, a new one under the shared folder if none is named.
    """
    spark = docs.sparkSession
    folder = folder or _uri(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    made = written(sequences(docs, key, text))
    name = F.format_string("%s/shard-%08d.bin", F.lit(folder), F.col("shard"))
    shards = written(write_shards(materialise(made, seed, records), folder).select("shard", name.alias("shard_path"), F.col("crc32").alias("shard_crc32")))
    # places depend on part and number only: the ids, which the shards hold by now, don't move again
    placed = materialise(made.drop("ids"), seed, records).join(F.broadcast(shards), "shard")
    placed = placed.select("slot", "shard", "record", (F.col("record").cast("long") * 2 * LENGTH).alias("byte_offset"), "n_ids", F.col("keys").alias("doc_ids"), "shard_path", "shard_crc32")
    names = [*placed.columns, "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = file = None
        for batch in batches:
            ids = []
            for path, at in zip(batch.column(6).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path != held:
                    if file is not None:
                        file.close()
                    store, inner = fs.FileSystem.from_uri(path)
                    held, file = path, store.open_input_file(inner)
                ids.append(file.read_at(2 * LENGTH, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=names)
        if file is not None:
            file.close()

    whole = placed.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in placed.dtypes) + ", ids binary")
    return whole.select("slot", "shard", "record", "byte_offset", "n_ids", F.crc32("ids").alias("ids_crc32"), "doc_ids", "ids", "shard_path", "shard_crc32")
