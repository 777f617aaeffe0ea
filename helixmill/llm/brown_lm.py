"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

Units are clustered: a word with at least one of SHARE training tokens, and LEAST of them, is a unit of its own, so
that there are at most SHARE at every size; rarer and unknown words share the unit of their shape, a digest of their
last TAIL bytes; a text's end, which also stands before its first word, is a unit in a class of its own. Every
unit, and so every word, gets its class by exchange: with the class bigrams N(a, b) and class counts N(a) of all
training tokens, a unit moves to the class that raises sum N(a, b) log N(a, b) - 2 sum N(a) log N(a) most. The
most frequent units seed the classes, the others are placed, and then a hashed half of the units moves in each round
against the classes of the round before; a round that lowers the sum is undone, and the next moves fewer units.
A unit's neighbours lie in one row (at most as many as units), so that rounds shuffle nothing.

A token w of class c after one of class p has the probability P(c | p) P(u | c) P(w | u): absolutely discounted
class bigrams over class counts; the unit's share of its class, shapes with half a token more; and within a
shape (n(w) - D) / n(u), D = n1 / (n1 + 2 n2), the rest for all words that training lacks, as one type for each
shape. The probabilities of the training words and these types add up to 1 after any word.

Words are 64-bit digests: n distinct words hold about n**2 / 2**65 pairs that count as one (10**-5 for 20
million words). Counts of rare words are never sent to all tasks: the texts' rare words meet the table of words in a join.

Edge cases: null and empty texts are an end alone; null ids are in training; repeated rows count as often as
they occur; without training rows every word is unknown; columns that clash with the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes
from ._bytes import WHITE_WORDS, U
from ._spark import written

SHARE, LEAST, SHAPES, TAIL = 1 << 17, 4, 4096, 3
CLASSES, ROUNDS = 64, 12
#: The digest of a text's end; groups of units' neighbours; pairs or words that a task holds before it hands them on.
END, BUCKETS, HELD = U(0x9AE16A3B2F90404F), 256, 1 << 21
RESULTS = ["n_tokens", "n_known", "base_score", "score"]


@dataclass
class Units:
    """Digests of the frequent words, sorted; the unit of each; counts by unit. Units: frequent words from the most frequent on, shapes, the end."""

    core: np.ndarray
    unit: np.ndarray
    counts: np.ndarray

    @property
    def end(self) -> int:
        return len(self.counts) - 1

    def of(self, h: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.core, h), max(0, len(self.core) - 1))
        shape = len(self.core) + shape_of(tails)
        return np.where(self.core[at] == h, self.unit[at], shape) if len(self.core) else shape


@dataclass
class Model:
    units: Units
    classes: np.ndarray
    steps: np.ndarray
    emits: np.ndarray
    words: DataFrame
    kinds: np.ndarray
    discount: float
    tokens: int
    types: int
    ends: int


def shape_of(tails: np.ndarray) -> np.ndarray:
    return (tails >> U(64 - SHAPES.bit_length() + 1)).astype(np.int64)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the tokens of the rows, of their last bytes, whether each is an end, and each row's first token."""
    h, first, tails = _bytes.words(data, off, WHITE_WORDS, -TAIL)
    at = first[1:] + np.arange(len(first) - 1)
    n = len(h) + len(at)
    ends = np.zeros(n, bool)
    ends[at] = True
    out, last = np.full(n, END), np.zeros(n, U)
    out[~ends], last[~ends] = h, tails
    return out, last, ends, np.append(0, at + 1)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> w, shape, n of the task's tokens, added up before they leave it."""
    keys, counts, shapes = [], [], []

    def made() -> pa.RecordBatch:
        k, s, n = np.concatenate(keys), np.concatenate(shapes), np.concatenate(counts)
        k, at, back = np.unique(k, return_index=True, return_inverse=True)
        s, n = s[at], np.bincount(back, n, len(k)).astype(np.int64)
        keys[:], shapes[:], counts[:] = [k], [s], [n]
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s), pa.array(n)], ["w", "shape", "n"])

    for batch in batches:
        data, off = _bytes.buffer(batch.column(0))
        for lo, hi in _bytes.runs(off):
            h, tails, _, _ = tokens(data, off[lo : hi + 1])
            k, at, n = np.unique(h, return_index=True, return_counts=True)
            keys.append(k)
            shapes.append(shape_of(tails[at]).astype(np.int32))
            counts.append(n)
        if sum(map(len, keys)) > HELD:
            out = made()
            if out.num_rows > HELD // 2:
                for x in (keys, shapes, counts):
                    x.clear()
                yield out
    if keys:
        yield made()


def _pairs(shared, size: int):
    """text -> bucket, data: the task's pairs of units by the bucket of either, sorted, as compressed differences and counts."""

    def blobs(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = []
        for side in (0, 1):  # neighbours before, neighbours after
            u, v = (key % size, key // size) if side == 0 else (key // size, key % size)
            order = np.lexsort((v, u, u % BUCKETS))
            bucket, packed, m = (u % BUCKETS)[order], ((u * 2 + side) * size + v)[order], n[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                rows.append((int(bucket[lo]), zlib.compress(np.diff(packed[lo:hi], prepend=0).astype("<i8").tobytes(), 1), zlib.compress(m[lo:hi].astype("<i8").tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = shared.value
        keys, counts = [], []
        for batch in batches:
            data, off = _bytes.buffer(batch.column(0))
            for lo, hi in _bytes.runs(off):
                h, tails, ends, _ = tokens(data, off[lo : hi + 1])
                u = np.where(ends, units.end, units.of(h, tails))
                k, n = np.unique(np.append(units.end, u[:-1]) * size + u, return_counts=True)  # the row before ends as this one begins
                keys.append(k)
                counts.append(n)
            if sum(map(len, keys)) > HELD:
                k, n = _summed(keys, counts)
                keys[:], counts[:] = [k], [n]
                if len(k) > HELD // 2:
                    yield from blobs(k, n)
                    keys.clear()
                    counts.clear()
        if keys:
            yield from blobs(*_summed(keys, counts))

    return pairs


def _neighbours(size: int):
    """The rows of one bucket: unit, and of each side the neighbours and counts."""

    def met(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for part in parts:
            for k, n in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist(), strict=True):
                keys.append(np.cumsum(np.frombuffer(zlib.decompress(k), "<i8")))
                counts.append(np.frombuffer(zlib.decompress(n), "<i8"))
            if sum(map(len, keys)) > 2 * HELD:
                k, n = _summed(keys, counts)
                keys[:], counts[:] = [k], [n]
        k, n = _summed(keys, counts)
        side, other = k // size, k % size
        rows = {}
        cuts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        for lo, hi in zip(cuts, [*cuts[1:], len(side)], strict=True):
            u, s = divmod(int(side[lo]), 2)
            rows.setdefault(u, {})[s] = (other[lo:hi].astype("<i4").tobytes(), n[lo:hi].astype("<i8").tobytes())
        each = list(rows)
        arrays = [pa.array(each, pa.int32())] + [pa.array([rows[u].get(s, (b"", b""))[i] for u in each], pa.binary()) for s in (0, 1) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(arrays, ["unit", "v0", "n0", "v1", "n1"])

    return met


def entropy(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def value(matrix: np.ndarray) -> float:
    """What exchange raises: the log-likelihood but for what no class changes."""
    return float(entropy(matrix).sum() - entropy(matrix.sum(0)).sum() - entropy(matrix.sum(1)).sum())


def gains(matrix: np.ndarray, l: np.ndarray, r: np.ndarray, own: np.ndarray, n: np.ndarray, now: np.ndarray, classes: int) -> np.ndarray:  # noqa: E741
    """Of each unit and class: what the value rises by if the unit, taken out of its class `now`, enters it. l, r: its neighbours before and after by class, itself (own) left out."""
    i, k = np.arange(len(l)), np.arange(classes)
    m = np.repeat(matrix[None], len(l), 0)
    m[i, :, now] -= l
    m[i, now, :] -= r
    m[i, now, now] -= own
    whole = np.repeat(matrix.sum(1)[None], len(l), 0)
    whole[i, now] -= n
    before = entropy(m)
    column = entropy(m[:, :, :classes] + l[:, :, None]) - before[:, :, :classes]
    row = entropy(m[:, :classes] + r[:, None, :]) - before[:, :classes]
    cross = entropy(m[:, k, k] + l[:, :classes] + r[:, :classes] + own[:, None]) - before[:, k, k]
    out = column.sum(1) - column[:, k, k] + row.sum(2) - row[:, k, k] + cross
    return out - 2 * (entropy(whole[:, :classes] + n[:, None]) - entropy(whole[:, :classes]))


def _by_class(v: bytes, n: bytes, classes: np.ndarray, kinds: int) -> np.ndarray:
    return np.bincount(classes[np.frombuffer(v, "<i4")], np.frombuffer(n, "<i8"), kinds)


def _matrix(contexts: DataFrame, classes: np.ndarray, kinds: int) -> np.ndarray:
    """Class bigrams of all training tokens; the driver gets a matrix of each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((kinds, kinds))
        for batch in batches:
            for u, v, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out[:, classes[u]] += _by_class(v, n, classes, kinds)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], ["m"])

    parts = contexts.select("unit", "v0", "n0").mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r.m, "<f8").reshape(kinds, kinds) for r in parts), np.zeros((kinds, kinds)))


def _moves(contexts: DataFrame, classes: np.ndarray, matrix: np.ndarray, count: int, turn: int, part: int) -> np.ndarray:
    """The classes after a round: of the units that a hash picks (all that have none yet), each goes where it gains most."""
    kinds, fixed, loose = len(matrix), count, count + 1

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(0).to_numpy().astype(np.int64)
            picked = (classes[unit] == loose) | (_bytes.mix(unit.astype(U) * U(64) + U(turn)) % U(part) == 0)
            rows = np.flatnonzero(picked & (classes[unit] != fixed))
            for lo in range(0, len(rows), 128):
                at = rows[lo : lo + 128]
                v0, n0, v1, n1 = (batch.column(c).take(pa.array(at)).to_pylist() for c in range(1, 5))
                l = np.stack([_by_class(v, n, classes, kinds) for v, n in zip(v0, n0, strict=True)])  # noqa: E741
                r = np.stack([_by_class(v, n, classes, kinds) for v, n in zip(v1, n1, strict=True)])
                n, now = l.sum(1), classes[unit[at]].astype(int)
                own = np.array([np.frombuffer(c, "<i8")[np.frombuffer(v, "<i4") == u].sum() for v, c, u in zip(v0, n0, unit[at], strict=True)], float)
                l[np.arange(len(at)), now] -= own
                r[np.arange(len(at)), now] -= own
                g = gains(matrix, l, r, own, n, now, count)
                best = np.argmax(g, 1)
                stay = (now < count) & (g[np.arange(len(at)), best] <= g[np.arange(len(at)), np.minimum(now, count - 1)] + 1e-6)
                best = np.where(stay, now, best)
                yield pa.RecordBatch.from_arrays([pa.array(unit[at].astype(np.int32)), pa.array(best.astype(np.int32))], ["unit", "class"])

    out = classes.copy()
    for u, c in contexts.mapInArrow(move, "unit int, class int").collect():  # as many as units at most
        out[u] = c
    return out


def exchange(contexts: DataFrame, counts: np.ndarray, count: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the units (the last, the end, has the class `count`), their bigrams and the value after each round kept."""
    classes = np.full(len(counts), count + 1, np.int32)
    classes[-1] = count
    seeds = np.argsort(-counts[:-1], kind="stable")[:count]
    classes[seeds] = np.arange(len(seeds))
    matrix = _matrix(contexts, classes, count + 2)
    kept, part = [], 2
    for turn in range(rounds):
        moved = _moves(contexts, classes, matrix, count, turn, part)
        if (moved == classes).all():
            break
        after = _matrix(contexts, moved, count + 2)
        worth = value(after)
        if not kept or worth > kept[-1]:
            classes, matrix = moved, after
            kept.append(worth)
            if len(kept) > 1 and worth - kept[-2] < 1e-5 * abs(worth):
                break
        else:
            part *= 2
    return classes, matrix, kept


def learn(texts: DataFrame, text: str = "text", share: int = SHARE, least: int = LEAST, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """A model of all texts. The driver sees the frequent words (`share` at most), sums by shape, and classes of units."""
    spark, plain = texts.sparkSession, texts.select(F.col(text).cast("string").alias("text"))
    counted = written(plain.mapInArrow(_words, "w long, shape int, n long").groupBy("w").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    end = int(END.view(np.int64))
    rare = F.col("w") != end
    total = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(rare, (F.col("n") == 1).cast("long"))).alias("n1"), F.sum(F.when(rare, (F.col("n") == 2).cast("long"))).alias("n2"), F.max(F.when(~rare, F.col("n"))).alias("ends")).first()
    n, n1, n2 = total.n or 0, total.n1 or 0, total.n2 or 0
    often = (F.col("n") * share >= n) & (F.col("n") >= least)
    common = counted.where(rare & often).select("w", "n").collect() if n else []
    common = sorted(common, key=lambda r: (-r.n, r.w))
    words = counted.where(rare & ~often).select("w", "shape", "n")
    kinds = np.zeros((2, SHAPES))  # tokens and types of the shapes' words
    for shape, tokens_, types in words.groupBy("shape").agg(F.sum("n"), F.count(F.lit(1))).collect():
        kinds[:, shape] = tokens_, types
    core = np.array([r.w for r in common], np.int64).view(U)
    order = np.argsort(core)
    counts = np.concatenate([[r.n for r in common], kinds[0], [total.ends or 0]])
    units = Units(core[order], order.astype(np.int64), counts)
    size = len(counts)
    shared = spark.sparkContext.broadcast(units)
    pairs = plain.mapInArrow(_pairs(shared, size), "bucket int, keys binary, counts binary")
    contexts = written(pairs.groupBy("bucket").applyInArrow(_neighbours(size), "unit int, v0 binary, n0 binary, v1 binary, n1 binary"))
    of, matrix, _ = exchange(contexts, counts, classes, rounds)
    shared.destroy()
    shapes = slice(len(core), size - 1)
    weight = np.bincount(of[shapes], kinds[0], classes + 2)[:classes]
    of = np.where(of > classes, int(np.argmax(weight)), of)  # shapes that training lacks
    steps, emits = probabilities(matrix[: classes + 1, : classes + 1], of, counts, shapes)
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    return Model(units, of, np.log10(steps), np.log10(emits), words, kinds, discount, n, total.v or 0, total.ends or 0)


def probabilities(matrix: np.ndarray, classes: np.ndarray, counts: np.ndarray, shapes: slice) -> tuple[np.ndarray, np.ndarray]:
    """P(class | class before), and P(unit | class) by unit."""
    k = len(matrix)
    once, twice = (matrix == 1).sum(), (matrix == 2).sum()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    whole = matrix.sum(0) + 0.5
    shared = whole / whole.sum()
    rows = matrix.sum(1, keepdims=True)
    spared = np.minimum(matrix, discount).sum(1, keepdims=True)
    steps = np.where(rows > 0, (np.maximum(matrix - discount, 0) + spared * shared) / np.maximum(rows, 1), shared)
    more = counts.astype(float).copy()
    more[shapes] += 0.5
    more[-1] = max(more[-1], 1)
    mass = np.bincount(classes, more, k)
    return steps, more / mass[classes]


def score(docs: DataFrame, m: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of docs with n_tokens, n_known, base_score (add-one unigrams), score (log10 of the model's probability) and perplexity."""
    spark = docs.sparkSession
    kept = [c for c in keep if c not in (*RESULTS, "perplexity")]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_uid"), *[F.col(f"`{c}`") for c in kept])
    shared = spark.sparkContext.broadcast((m.units, m.classes, m.steps, m.emits, np.log10(np.maximum(m.kinds[0], 1)), np.log10(m.units.counts + 1)))
    norm, core = np.log10(m.tokens + m.types + 1), len(m.units.core)
    known_end = int(m.ends > 0)
    rest = T.ArrayType(T.StructType([T.StructField("w", T.LongType()), T.StructField("s", T.ShortType()), T.StructField("k", T.IntegerType())]))
    schema = T.StructType([*rows.schema.fields[1:], *[T.StructField(f"_{x}", T.LongType() if x[0] == "n" else T.DoubleType()) for x in RESULTS], T.StructField("_rest", rest)])
    names = schema.fieldNames()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, classes, steps, emits, spread, plus = shared.value
        for batch in batches:
            data, off = _bytes.buffer(batch.column(0))
            for lo, hi in _bytes.runs(off):
                h, tails, ends, first = tokens(data, off[lo : hi + 1])
                u = np.where(ends, units.end, units.of(h, tails))
                c = classes[u]
                shape = (u >= core) & ~ends
                logs = steps[np.append(classes[-1], c[:-1]), c] + emits[u] - np.where(shape, spread[np.where(shape, u - core, 0)], 0)
                total = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else np.zeros(0)  # noqa: E731  each row has an end
                n = np.diff(first)
                sure = total(np.where(ends, known_end, ~shape).astype(np.int64))
                base = total(np.where(shape, 0.0, plus[u])) - n * norm
                row = np.repeat(np.arange(len(n)), n)[shape]
                order = np.lexsort((h[shape], row))
                w, row, s = h[shape][order], row[order], (u[shape] - core)[order]
                at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (row[1:] != row[:-1]))) if len(w) else np.zeros(0, int)
                times = np.diff(np.append(at, len(w))).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(w[at].view(np.int64)), pa.array(s[at].astype(np.int16)), pa.array(times)], ["w", "s", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(n) + 1)).astype(np.int32)), struct)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array(n.astype(np.int64)), pa.array(sure), pa.array(base), pa.array(total(logs)), lists], names)

    local = written(rows.mapInArrow(sums, schema))
    unknown = np.log10(np.maximum(m.discount * m.kinds[1], 1e-300))
    unknown = F.broadcast(spark.createDataFrame([(i, float(x) if m.kinds[1][i] else 0.0) for i, x in enumerate(unknown)], "s short, unknown double"))  # a row a shape
    each = local.select("_uid", F.explode("_rest").alias("x")).select("_uid", "x.*").join(m.words.select("w", "n"), "w", "left").join(unknown, "s")
    known, k = F.col("n").isNotNull(), F.col("k")
    added = each.groupBy("_uid").agg(
        F.sum(F.when(known, k).otherwise(0)).alias("_more"),
        F.sum(F.when(known, k * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("_base"),
        F.sum(k * F.when(known, F.log10(F.col("n") - m.discount)).otherwise(F.col("unknown"))).alias("_logs"),
    )
    met = local.drop("_rest").join(added, "_uid", "left").na.fill(0, ["_more", "_base", "_logs"])
    out = met.select(*[F.col(f"`{c}`") for c in kept], F.col("_n_tokens").alias("n_tokens"), (F.col("_n_known") + F.col("_more")).alias("n_known"), (F.col("_base_score") + F.col("_base")).alias("base_score"), (F.col("_score") + F.col("_logs")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 7; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))
