"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give each word the product of the steps along its prefixes: its first
4 bytes, 6 given those, 8 given those, and the word given those. Whole expressions rarely recur; their
heads do, in inflected and compound words too. In class c a step from parent p to child x has the
interpolated, absolutely discounted probability

    p_c(x | p) = (max(n_c(x) - D, 0) + (D * m_c(p) + T) * p(x | p)) / (n_c(p) + T)
    p(x | p)   = (n(x) + 1/2) / (n(p) + (m(p) + 1) / 2)

All counts are continuation counts: n_c(x) is the number of distinct pairs of a word with head x and
the word before it in the class, so that copies and phrases that recur whole add nothing; m_c(p) is the
number of distinct children of p in the class; n and m are the same of both classes together. What a
class has not seen backs off to these shared counts, and has no evidence if neither class knows it.

All pairs of all labelled rows are counted exactly, by aggregation. The counts go to the workers in
hashed bins, in which heads that share a bin add up; the number of bins grows with the distinct heads,
up to 2**LEVEL_BITS, which bounds what is sent. Beyond so many distinct words a rare word's evidence
is watered down by that of the others in its bin, while the counts of common words and heads hold.

The two log-likelihoods are compared by their difference, normalised by length: over all words, and
over those that differ by more than STRONG alone, since toxic texts are mostly ordinary prose. A text's score is a logistic
function of these, fitted on a bounded sample of the learning rows with their own counts taken out.

Edge cases: a null or wordless text scores the share of toxic rows; labels that are null, or whose
id is null, teach nothing; of several labels of one id the largest holds; repeated documents count
as often as they occur; without both classes all texts score the share of toxic rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes
from ._bytes import LETTER_WORDS, U
from ._spark import written

#: Bytes of the prefixes; the last level is the whole word. The most bins of the levels and of pairs, and bins to a block of them, in bits.
HEADS = (4, 6, 8)
LEVEL_BITS, PAIR_BITS, BLOCK_BITS = (16, 18, 19, 20), 21, 12
DISCOUNT, THETA, STRONG = 0.75, 1.0, 2.0
#: What stands before a text's first word.
START = U(0x9AE16A3B2F90404F)
#: Pairs that a task holds before it hands on their counts.
HELD = 1 << 18
#: The bit set that spares rows without a label the way to the join, in bits of the hash of the id.
ID_BITS = 23
FEATURES = 3


@dataclass
class Counts:
    """Tables by bin, of both classes and of both together: n of each level, m of each level but the last; and n and m of the root."""

    n: list[np.ndarray]
    m: list[np.ndarray]
    total: np.ndarray
    heads: np.ndarray


@dataclass
class Model:
    """The counts, compressed as workers get them; the logistic function; the share of toxic rows."""

    packed: bytes
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    prior: float


def packed(*tables) -> bytes:
    small = lambda t: t.astype(np.int32) if t.max(initial=0) < 1 << 31 else t
    return zlib.compress(pickle.dumps([[small(t) for t in x] if isinstance(x, list) else x for x in tables]), 1)


@lru_cache(maxsize=2)
def unpacked(data: bytes) -> list:
    return pickle.loads(zlib.decompress(data))


def counts_of(data: bytes) -> Counts:
    return Counts(*unpacked(data))


def words(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Digests of all words of the rows by level, of the word before each, and each row's first word."""
    h, first, _ = _bytes.words(data, off, LETTER_WORDS)
    before = np.append(START, h[:-1]) if len(h) else h
    before[first[:-1][first[:-1] < len(h)]] = START
    before >>= U(32)
    return [*(_bytes.words(data, off, LETTER_WORDS, n)[2] for n in HEADS), h], before, first


def pair_of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _bytes.mix(v * U(0xA24BAED4963EE407) + w)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> w, v, k_0, k_1 of the task's pairs, added up before they leave it; v is 32 bits of the digest of the word before."""
    held: list[tuple[np.ndarray, ...]] = []

    def made() -> pa.RecordBatch:
        w, v, k0, k1 = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, t) for t in (U, U, np.int32, np.int32))
        held.clear()
        order = np.argsort(pair_of(v, w))
        w, v = w[order], v[order]
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]))) if len(w) else np.zeros(0, int)
        held.append((w[at], v[at], *(np.add.reduceat(k[order], at) if len(at) else k for k in (k0, k1))))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(held[0], (np.int64, np.int64, np.int32, np.int32), strict=True)], ["w", "v", "k_0", "k_1"])

    for batch in batches:
        toxic = batch.column(0).to_numpy().astype(bool)
        data, off = _bytes.buffer(batch.column(1))
        for lo, hi in _bytes.runs(off):  # a batch may hold millions of pairs, a run some hundred thousand or one text's
            levels, v, first = words(data, off[lo : hi + 1])
            of = np.repeat(toxic[lo:hi], np.diff(first))
            held.append((levels[-1], v, (~of).astype(np.int32), of.astype(np.int32)))
            if sum(len(x[0]) for x in held) > HELD:
                out = made()
                if out.num_rows > HELD // 2:
                    held.clear()
                    yield out
    yield made()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> each batch's distinct words by level."""
    for batch in batches:
        data, off = _bytes.buffer(batch.column(0))
        for lo, hi in _bytes.runs(off):
            levels, _, _ = words(data, off[lo : hi + 1])
            at = np.unique(levels[-1], return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int64)) for x in levels], LEVELS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, v, k_0, k_1 -> key of the pair, k_0, k_1."""
    for batch in batches:
        w, v = (batch.column(k).to_numpy().view(U) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(pair_of(v, w).view(np.int64)), batch.column(2), batch.column(3)], ["key", "k_0", "k_1"])


LEVELS = [*(f"p{n}" for n in HEADS), "w"]


def _added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one block of bins; holds one block whatever the number of parts."""
    total: np.ndarray | int = 0
    for part in parts:
        for data in part.column("sums").to_pylist():
            total = total + np.frombuffer(zlib.decompress(data), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "sums"])


def _table(rows: DataFrame, columns: tuple[str, ...], bits: int) -> np.ndarray:
    """Sums of the columns by the leading bits of `key`, added up by each task first: the driver gets a table of bounded size."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), 1 << bits), np.int64)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(U) >> U(64 - bits)).astype(np.int64)
            for k in range(len(columns)):
                np.add.at(total[k], at, batch.column(1 + k).to_numpy())
        blocks = total.reshape(len(columns), -1, 1 << BLOCK_BITS).swapaxes(0, 1)
        filled = np.flatnonzero(blocks.any((1, 2))).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([zlib.compress(blocks[b].astype("<i8").tobytes(), 1) for b in filled], pa.binary())], ["block", "sums"])

    out = np.zeros((len(columns), 1 << bits), np.int64)
    parts = rows.select("key", *columns).mapInArrow(binned, "block long, sums binary")
    for block, data in parts.groupBy("block").applyInArrow(_added, "block long, sums binary").collect():
        out[:, block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(data), "<i8").reshape(len(columns), -1)
    return out


def count(learning: DataFrame, level_bits: tuple[int, ...] = LEVEL_BITS, pair_bits: int = PAIR_BITS) -> tuple[Counts, np.ndarray]:
    """Counts of written (toxic, text) rows, and how often each class has each pair, by bin."""
    pairs = learning.mapInArrow(_pairs, "w long, v long, k_0 int, k_1 int").groupBy("w", "v").agg(*[F.sum(f"k_{c}").cast("int").alias(f"k_{c}") for c in (0, 1)])
    pairs = written(pairs)
    by_word = pairs.groupBy("w").agg(*[F.sum((F.col(f"k_{c}") > 0).cast("long")).alias(f"n_{c}") for c in (0, 1)], F.count(F.lit(1)).alias("n_2"))
    heads = learning.select("text").mapInArrow(_heads, ", ".join(f"{x} long" for x in LEVELS)).groupBy("w").agg(*[F.first(x).alias(x) for x in LEVELS[:-1]])
    by_word = written(heads.join(by_word, "w"))
    n, m = [], []
    sums = [F.sum(f"n_{c}").alias(f"n_{c}") for c in range(3)]
    sizes = by_word.agg(*[F.approx_count_distinct(x) for x in LEVELS], *sums).first()
    bits = [min(most, max(BLOCK_BITS, 1 + int(size or 0).bit_length())) for most, size in zip(level_bits, sizes, strict=False)]
    for x, b in zip(LEVELS, bits, strict=True):
        n.append(_table(by_word.select(F.col(x).alias("key"), *[f"n_{c}" for c in range(3)]), ("n_0", "n_1", "n_2"), b))
    for x, child, b in zip(LEVELS, LEVELS[1:], bits, strict=False):
        met = by_word.groupBy(F.col(x).alias("key"), F.col(child).alias("child")).agg(*[F.max((F.col(f"n_{c}") > 0).cast("long")).alias(f"n_{c}") for c in range(3)])
        m.append(_table(met.drop("child"), ("n_0", "n_1", "n_2"), b))
    roots = by_word.groupBy(LEVELS[0]).agg(*sums).agg(*[F.sum((F.col(f"n_{c}") > 0).cast("long")) for c in range(3)]).first()
    number = lambda row: np.array([x or 0 for x in row], float)
    of_pairs = _table(pairs.mapInArrow(_keyed, "key long, k_0 int, k_1 int"), ("k_0", "k_1"), min(pair_bits, max(BLOCK_BITS, 1 + int(sizes[-1] or 0).bit_length())))
    return Counts(n, m, number(sizes[len(LEVELS) :]), number(roots)), of_pairs


def _bin(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (key >> U(65 - table.shape[1].bit_length())).astype(np.int64)


def ratios(c: Counts, levels: list[np.ndarray], lost: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Log ratio, toxic to ordinary, of each word of a run of texts; or of one text whose class is lost[0], without the pairs that only it has there and in both (lost[1])."""
    n = [t[:, _bin(x, t)].astype(float) for t, x in zip(c.n, levels, strict=True)]
    m = [t[:, _bin(x, t)].astype(float) for t, x in zip(c.m, levels, strict=False)]
    total, heads = np.repeat(c.total[:, None], len(levels[0]), 1), np.repeat(c.heads[:, None], len(levels[0]), 1)
    if lost is not None:
        own, gone = lost
        parent = np.zeros(len(levels[0]), np.int64)
        for k, x in enumerate(levels):
            _, at, inverse = np.unique(x, return_index=True, return_inverse=True)
            less = np.stack([np.bincount(inverse, g) for g in gone])  # pairs that each head of this level loses: in the class, in both
            for row, g in ((own, less[0]), (2, less[1])):
                n[k][row] = np.maximum(n[k][row] - g[inverse], 0)
                ended = (n[k][row][at] == 0) & (g > 0)
                if k:
                    m[k - 1][row] = np.maximum(m[k - 1][row] - np.bincount(parent[at], ended, parent.max(initial=0) + 1)[parent], 0)
                else:
                    heads[row] -= ended.sum()
                if not k:
                    total[row] -= g.sum()
            parent = inverse
    out = np.zeros(len(levels[0]))
    of, kids = total, heads
    for k in range(len(levels)):
        shared = (n[k][2] + 0.5) / (of[2] + (kids[2] + 1) / 2)
        step = [(np.maximum(n[k][a] - DISCOUNT, 0) + (DISCOUNT * kids[a] + THETA) * shared) / (of[a] + THETA) for a in (0, 1)]
        out += np.log(step[1] / step[0])
        of, kids = n[k], m[k] if k < len(m) else None
    return out


def _lost(pairs: np.ndarray, own: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """1 for one place of each pair that only this text has: in its class, and in both."""
    g = pair_of(v, w)
    _, at, count = np.unique(g, return_index=True, return_counts=True)
    rest = pairs[:, _bin(g[at], pairs)].astype(np.int64)
    rest[own] -= count
    out = np.zeros((2, len(g)))
    out[0, at], out[1, at] = rest[own] <= 0, rest.sum(0) <= 0
    return out


def _summary(ratio: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: the mean log ratio, the mean of what it is over STRONG, and 1 / (1 + words)."""
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES))
    for k, x in enumerate((ratio, np.maximum(ratio - STRONG, 0))):
        sums = np.concatenate([[0.0], np.cumsum(x)])
        out[:, k] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    out[:, 2] = 1 / (1 + n)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge] * x.shape[1] + [1e-6])
        w -= np.linalg.solve(h, g)
    return w


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, toxic, text) of the documents that have a label. Ids pass a bit set of fixed size before their texts are shuffled."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    spark, mask = docs.sparkSession, (1 << ID_BITS) - 1
    h = F.xxhash64(F.col("key").cast("string"))
    parts = known.select(F.shiftright(h.bitwiseAND(F.lit(mask)), 6).alias("at"), h.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = np.zeros((1 << ID_BITS) // 64, np.int64)
    for at, word in parts.collect():
        bits[at] = word
    shared = spark.sparkContext.broadcast(bits)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(2).to_numpy().astype(np.int64) & mask
            here = (shared.value[code >> 6] >> (code & 63)) & 1 == 1
            yield batch.filter(pa.array(here)).select([0, 1])

    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("*", h.alias("h")).mapInArrow(likely, f"key {kind}, text string").join(known, "key")


def train(learning: DataFrame, sample: int = 4000, seed: int = 11) -> Model:
    """Fit from (key, toxic, text). All rows are counted; the logistic function is fitted on about `sample` of them (a documented bound), half of them toxic if there are as many."""
    sizes = {r[0]: r[1] for r in learning.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts, pairs = count(learning.select("toxic", "text"))
    parts = [counts.n, counts.m, counts.total, counts.heads]
    m = Model(packed(*parts), np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1))
    if len(sizes) < 2:
        return m
    keep = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, sample / 2 / sizes[1]) * (1 << 31)))).otherwise(F.lit(int(min(1.0, sample / 2 / sizes[0]) * (1 << 31))))
    chosen = learning.where(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(seed)), F.lit(1 << 31)) < keep).select("toxic", "text")
    shared = learning.sparkSession.sparkContext.broadcast(packed(*parts, [pairs]))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *tables, (pairs,) = unpacked(shared.value)
        for batch in batches:
            data, off = _bytes.buffer(batch.column(1))
            toxic = batch.column(0).to_pylist()
            x = np.zeros((len(toxic), FEATURES))
            for r, t in enumerate(toxic):
                levels, v, first = words(data, off[r : r + 2])
                lost = int(bool(t)), _lost(pairs, int(bool(t)), v, levels[-1])
                x[r] = _summary(ratios(Counts(*tables), levels, lost), first)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(FEATURES)]], ["toxic", *[f"x{k}" for k in range(FEATURES)]])

    rows = np.array(chosen.mapInArrow(own, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).collect(), float)
    shared.destroy()
    if len(rows) and 0 < rows[:, 0].sum() < len(rows):
        rows = rows[np.lexsort(rows.T)]
        y, x = rows[:, 0], rows[:, 1:]
        m.mean, m.spread = x.mean(0), x.std(0) + 1e-6
        m.weights = _logistic((x - m.mean) / m.spread, y)
        taken = [min(1.0, sample / 2 / sizes[k]) for k in (0, 1)]
        m.weights[-1] += math.log(taken[0] / taken[1])  # the sample has more toxic rows than the corpus
    return m


def score(docs: DataFrame, m: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(m.packed)
    weights, mean, spread, prior = m.weights, m.mean, m.spread, m.prior
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    names, position = [*kept.columns, name], kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(shared.value)
        for batch in batches:
            data, off = _bytes.buffer(batch.column(position))
            out = np.full(batch.num_rows, prior)
            for lo, hi in _bytes.runs(off):
                levels, _, first = words(data, off[lo : hi + 1])
                z = ((_summary(ratios(counts, levels), first) - mean) / spread) @ weights[:-1] + weights[-1]
                full = np.diff(first) > 0
                if weights.any():
                    out[lo:hi][full] = 1 / (1 + np.exp(-np.clip(z[full], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=names)

    return kept.mapInArrow(likelihoods, schema)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return train(written(labelled(docs, labels)), **options)
