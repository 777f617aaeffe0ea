"""Exact n-gram Jaccard join by set-relation skipping.

A document's set holds 64-bit digests of its distinct word shingles. Documents with equal sets are
one class and take part once.

Index. One global order of shingles, the rarer first, is made of counts over all documents in bins
of fixed number; any total order is exact, and a full bin only prunes less. A class stands in the
inverted lists of its first n - ceil(t * n) + 1 shingles, with its size and its position in them:
two sets that link share one of these. Lists with a single class are dropped, and lists of shingles
that very many documents hold are dealt out in chunks, so that no task holds one whole.

Index-level skipping. If the first shingle that two sets share stands at positions i and j, they
differ in i + j + |(n - i) - (m - j)| shingles at least. List entries are keyed by blocks of size and
of position, and a probe meets only the blocks that this bound leaves open; within a block the bound
itself and parity sketches decide before any set is fetched.

Answer-level skipping. In some rounds one leader of each list is compared with the list's others.
A class that links with a leader takes over its answer (their component), and keeps the leader, with
the number of shingles in which the two differ, as its anchor. A list whose classes all have one
answer is closed. In the lists still open, a pair's overlap is derived from that of its anchors, give
or take the shingles in which each differs from its anchor; only pairs that this leaves undecided
have their own sets compared.

Sets are compared exactly, on 64-bit digests; two different shingles of one pair of documents
share a digest with probability 2**-64. No list, component or set is capped or collected.

Edge cases: a null or wordless text has an empty set and links with nothing; fewer words than the
width are one shingle; repeated rows and ids share a class; a null id never is a component's id but
where the component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._bytes import U, WHITE_WORDS, mix
from ._spark import cut, dropped, written

#: Bins of the shingle counts, and bins to a block of them, in bits.
BIN_BITS, BLOCK_BITS = 21, 12
#: Classes to a chunk of a long list, and pairs of one class to a copy of its set.
CHUNK, FAN = 256, 64
#: Longs in a parity sketch, and rounds of links to one class of a list.
SKETCH, ROUNDS = 8, 3
#: Bits for each wanted class, and the most bits, of the set that spares other classes the way to the join.
SEEN_RATE, SEEN_MOST = 128, 27


def set_of(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def class_of(s: np.ndarray) -> int:
    """The 64-bit digest of a set."""
    if not len(s):
        return 0
    total = np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True)
    return int(mix(total + np.array([len(s)], U) * U(0x9E3779B97F4A7C15)).astype(np.int64)[0])


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    data, off = _bytes.buffer(batch.column(column))
    for lo, hi in _bytes.runs(off):
        h, first, _ = _bytes.words(data, off[lo : hi + 1], WHITE_WORDS)
        shingle, at = _bytes.shingles(h, first, width)
        for r in range(hi - lo):
            yield set_of(shingle[at[r] : at[r + 1]])


def bins_of(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - BIN_BITS)).astype(np.int64)


def classes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row for each document: key, n (set size), cls (digest of the set). Then, with `block`, each task's counts of shingles by bin, each of its classes once."""
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, key_type = set(), np.zeros(1 << BIN_BITS, np.uint32), None
        for batch in batches:
            n, cls, key_type = [], [], batch.column(0).type
            for s in _sets(batch, 1, width):
                c = class_of(s)
                n.append(len(s))
                cls.append(c)
                if c not in seen:
                    seen.add(c)
                    np.add.at(counts, bins_of(s), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["key", "n", "cls", "block", "counts"])
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        filled = np.flatnonzero(blocks.any(1)).tolist()
        if filled:
            packed = [blocks[b].astype("<u1" if blocks[b].max() < 256 else "<u4").tobytes() for b in filled]
            none = pa.nulls(len(filled), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(filled), key_type), none, none, pa.array(filled, pa.int32()), pa.array(packed, pa.binary())], ["key", "n", "cls", "block", "counts"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(read, f"key {kind}, n long, cls long, block int, counts binary")


def _added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one block's counts; holds one block whatever the number of parts."""
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for part in parts:
        for data in part.column("counts").to_pylist():
            total += np.frombuffer(data, "<u1" if len(data) == 1 << BLOCK_BITS else "<u4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], ["block", "counts"])


def counted(found: DataFrame) -> bytes:
    """The counts of all bins (a table of fixed size), from a written table of `classes`."""
    counts = np.zeros((1 << BIN_BITS - BLOCK_BITS, 1 << BLOCK_BITS), "<u4")
    for block, data in found.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_added, "block int, counts binary").collect():
        counts[block] = np.frombuffer(data, "<u4")
    return counts.tobytes()


@lru_cache(maxsize=2)
def ranks(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each bin: its rank in the order (eighths of a doubling), and the number of chunks of its shingles' lists."""
    c = np.frombuffer(counts, "<u4").astype(np.int64)
    longest = max(CHUNK, 8 * int(c.mean()))
    return np.minimum(8 * np.log2(c + 1), 255).astype(np.uint8), (1 + c // longest).astype(np.int32)


def ordered(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: by rank, then by digest."""
    return s[np.argsort(rank[bins_of(s)], kind="stable")]


def prefix(n: int, num: int, den: int) -> int:
    """So many of a set's first shingles: sets that link share one of these."""
    return n - -(-n * num // den) + 1 if n else 0


def listed(docs: DataFrame, text: str, width: int, num: int, den: int, counts) -> DataFrame:
    """list, chunk, chunks, cls, n, i: the index, each class once from each task that has it. counts: a broadcast of `counted`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rank, chunks), seen = ranks(counts.value), set()
        lists, cls, size, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            at, m = np.concatenate(lists), np.array([len(x) for x in lists])
            of, many = np.repeat(np.array(cls, np.int64), m), chunks[bins_of(at)]
            i = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            chunk = (mix(of.astype(U)) % many.astype(U)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int64), chunk, many, of, np.repeat(np.array(size, np.int32), m), i.astype(np.int32))], ["list", "chunk", "chunks", "cls", "n", "i"])

        for batch in batches:
            for s in _sets(batch, 0, width):
                c = class_of(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    lists.append(ordered(s, rank)[: prefix(len(s), num, den)])
                    cls.append(c)
                    size.append(len(s))
                    held += len(lists[-1])
                    if held > 1 << 17:
                        yield made()
                        lists, cls, size, held = [], [], [], 0
        if lists:
            yield made()

    return docs.select(F.col(text).alias("text")).mapInArrow(read, "list long, chunk int, chunks int, cls long, n int, i int")


def shared_lists(index: DataFrame, num: int, den: int) -> DataFrame:
    """The index without repeats and without entries that no other class of their list comes near in size. Chunks of long lists stay as they are."""
    once = index.repartition("list", "chunk").dropDuplicates(["list", "chunk", "cls"])
    in_list = Window.partitionBy("list", "chunk").orderBy("n", "cls")
    beside = (F.lag("n").over(in_list) * den >= F.col("n") * num) | (F.col("n") * den >= F.lead("n").over(in_list) * num)
    return once.withColumn("_shared", F.coalesce(beside, F.lit(False))).where(F.col("_shared") | (F.col("chunks") > 1)).drop("_shared")


def parities(s: np.ndarray) -> np.ndarray:
    """A set's parity sketch: each item flips one bit, so that two sets differ in as many items at least as their sketches in bits."""
    odd = np.bincount((s & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _log(i: Column) -> Column:
    """The block of a position."""
    return F.floor(F.log2(i + 1))


def _cell(band: Column, at: Column) -> Column:
    """The bit, of 64, that stands for a block of sizes and one of positions; some share one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(11 * band + at, F.lit(64)).cast("int"))


def _placed(n: Column, i: Column, m: Column, j: Column, num: int, den: int) -> Column:
    """Whether two sets of sizes n and m may link whose first common shingle is at i and j."""
    return (i + j + F.abs((n - i) - (m - j))) * (den + num) <= (n + m) * (den - num)


def _sketched(x: Column, y: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Whether two sets may link by their parity sketches."""
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return differ * (den + num) <= (n + m) * (den - num)


class Seen:
    """A bit set of classes, broadcast: SEEN_RATE bits for each, 2**SEEN_MOST at most. It lets some others pass."""

    def __init__(self, wanted: DataFrame):
        log_bits = min(SEEN_MOST, max(16, (SEEN_RATE * wanted.count()).bit_length()))
        self.mask = (1 << log_bits) - 1
        at = F.col("cls").bitwiseAND(F.lit(self.mask))
        words = wanted.select(F.shiftright(at, 6).alias("at"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        bits = np.zeros((1 << log_bits) // 64, np.int64)
        for i, word in words.toLocalIterator():  # at most 2**SEEN_MOST / 64 rows
            bits[i] = word
        self.bits = wanted.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self):
        return {"mask": self.mask, "bits": self.bits}

    def has(self, cls):
        """Of a number, or of an array of them."""
        return self.bits.value[(cls & self.mask) >> 6] >> (cls & 63) & 1 == 1


def _fetched(docs: DataFrame, wanted: DataFrame, text: str, width: int, whole: bool) -> DataFrame:
    """Of the wanted classes, and of few others, a row each: cls, n and their items (as sorted unsigned 64-bit bytes) if `whole`, or else their parity sketches."""
    kept = Seen(wanted)
    of, kind, name = (lambda s: s.astype("<u8").tobytes(), pa.binary(), "items") if whole else (parities, pa.list_(pa.int64()), "parity")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, held = set(), [], 0  # a class once from each task

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), kind))], ["cls", "n", name])

        for batch in batches:
            for s in _sets(batch, 0, width):
                c = class_of(s)
                if len(s) and c not in seen and kept.has(c):
                    seen.add(c)
                    rows.append((c, len(s), of(s)))
                    held += 8 * len(s)
                    if held > 1 << 22:
                        yield made()
                        rows, held = [], 0
        yield made()

    found = docs.select(F.col(text).alias("text")).mapInArrow(read, f"cls long, n int, {name} " + ("binary" if whole else "array<long>"))
    return found.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", name)])


def overlaps(pairs: DataFrame, fetch) -> DataFrame:
    """a, b, common: of written pairs (a, b), the size of their intersection; fetch(classes) gives their sets. The set of an `a` with many pairs is copied, and its pairs are dealt out to the copies. A set goes from the exchange that finds it once straight to its pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, x = None, None  # each copy's own set (b is null) comes before its pairs
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for a, b, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                y = np.frombuffer(items.as_buffer(), "<u8")
                if b is None:
                    of, x = a, y.copy()
                elif of == a:
                    both = np.sort(np.concatenate([x, y]))
                    rows.append((a, b, int(np.count_nonzero(both[1:] == both[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "common"])

    sets = fetch(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
    copies = fans.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"))
    dealt = pairs.join(fans, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("copy"), "b")
    met = sets.join(copies.unionByName(dealt), "cls").select("a", "copy", "b", "items")
    return written(met.repartition("a", "copy").sortWithinPartitions("a", "copy", "b").select("a", "b", "items").mapInArrow(compare, "a long, b long, common int"))


def _linked(common: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return common * (den + num) >= (n + m) * num


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that links reach, by minimum labels with pointer jumping."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = step.join(label.select(F.col("u").alias("m"), F.col("l").alias("j")), "m", "left")
        new = cut(jump.select("u", F.col("l").alias("was"), F.least("m", "j").alias("l")))
        moved = not new.where("was != l").isEmpty()
        label = new.select("u", "l")
        if not moved:
            dropped(both)
            return label.withColumnRenamed("u", "node").withColumnRenamed("l", "root")


def _chunks(lists: DataFrame) -> DataFrame:
    """A row for each chunk of the lists."""
    return lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


class Join:
    """The state of one join: the open lists, the sketches of their classes, what was compared and what links."""

    def __init__(self, docs: DataFrame, text: str, width: int, num: int, den: int, found: DataFrame):
        self.num, self.den = num, den
        counts = docs.sparkSession.sparkContext.broadcast(counted(found))
        self.entries = written(shared_lists(listed(docs, text, width, num, den, counts), num, den))
        self.sketches = written(_fetched(docs, self.entries.select("cls").distinct(), text, width, False))
        self.fetch = lambda wanted: _fetched(docs, wanted, text, width, True)
        self.tried = self.links = self.anchors = self.answer = None
        self.passing: list[DataFrame] = []  # tables of the step under way

    def held(self, df: DataFrame) -> DataFrame:
        """df as a table that goes when its step is done."""
        self.passing.append(written(df))
        return self.passing[-1]

    def settled(self) -> None:
        """The step is done: what it wrote for itself goes."""
        dropped(*self.passing)
        self.passing = []

    def told(self) -> DataFrame:
        """The entries with their present answers."""
        if self.answer is None:
            return self.entries.withColumn("root", F.col("cls"))
        answer = self.answer.withColumnRenamed("node", "cls")
        return self.entries.join(answer, "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def untried(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), each once, that may link by their sketches and weren't compared before."""
        pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
        if self.tried is not None:
            pairs = pairs.join(self.tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti")
        pairs = pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
        x, y = (self.sketches.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}")) for s in ("a", "b"))
        met = pairs.join(x, "a").join(y, "b")
        return met.where(_sketched(F.col("p_a"), F.col("p_b"), F.col("n_a"), F.col("n_b"), self.num, self.den)).select("a", "b", "n_a", "n_b")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Written pairs (a, b, n_a, n_b) with the size of their intersection."""
        self.passing.append(overlaps(pairs.select("a", "b"), self.fetch))
        return self.passing[-1].join(pairs, ["a", "b"])

    def link(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs with `common` that link; they are added to the links."""
        good = written(pairs.where(_linked(F.col("common"), F.col("n_a"), F.col("n_b"), self.num, self.den)))
        self.links = good.select("a", "b") if self.links is None else self.links.unionByName(good.select("a", "b"))
        return good

    def round(self, turn: int) -> bool:
        """One leader of each list against the others: it stands at the head of its set, where the bound leaves most of the list open; lists with common classes take the same leader at first, and each its own later. Whether it found any link."""
        told = self.held(self.told())
        seed = ["cls", *(["list"] if turn else []), F.lit(turn)]
        one = F.min(F.struct(_log(F.col("i")).alias("at"), F.xxhash64(*seed).alias("h"), "cls", "root", "n", "i")).alias("one")
        open_ = self.held(told.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("chunks").alias("chunks"), one).where("low != high"))
        if open_.isEmpty():
            self.entries = self.entries.limit(0)
            self.settled()
            return False
        leads = _chunks(open_).select("list", "chunk", *[F.col(f"one.{c}").alias(f"x_{c}") for c in ("cls", "root", "n", "i")])
        met = leads.join(told, ["list", "chunk"])
        good = (F.col("x_root") != F.col("root")) & _placed(F.col("x_n"), F.col("x_i"), F.col("n"), F.col("i"), self.num, self.den)
        pairs = self.held(self.untried(met.where(good).select(F.col("x_cls").alias("a"), F.col("cls").alias("b"))))
        done = written(self.compared(pairs))
        self.tried = done.select("a", "b") if self.tried is None else self.tried.unionByName(done.select("a", "b"))
        good = self.link(done)
        anchors = good.select(F.col("b").alias("cls"), F.struct((F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("differ"), F.col("a").alias("anchor"), F.col("n_a").alias("n"), "common").alias("x"))
        self.anchors = anchors if self.anchors is None else self.anchors.unionByName(anchors)
        self.passing.append(self.entries)
        self.entries = written(told.drop("root").join(_chunks(open_), ["list", "chunk"], "left_semi"))
        self.settled()
        if good.isEmpty():
            return False
        self.answer = components(self.links)
        return True

    def band(self, n: Column) -> Column:
        """The block of a size."""
        return F.floor(F.log(n) / (1.01 * log(self.den / self.num) or 1.0))

    def celled(self, told: DataFrame, every: bool) -> DataFrame:
        """The entries with the cells of size and position that their list fills; unless `every`, those of the lists still open."""
        cells = F.bit_or(_cell(self.band(F.col("n")), _log(F.col("i")))).alias("cells")
        lists = told.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("chunks").alias("chunks"), cells)
        return told.join(_chunks(lists if every else lists.where("low != high")).select("list", "chunk", "cells"), ["list", "chunk"])

    def blocks(self, told: DataFrame, every: bool) -> DataFrame:
        """All pairs (a, b) of a list that may link by size and position and, unless `every`, have different answers. told: of `celled`."""
        n, i, band = F.col("n"), F.col("i"), self.band
        room = F.floor((n + n * self.den / self.num) * (self.den - self.num) / (self.den + self.num)) - i  # the other's position at most
        y = told.select("list", band(n).alias("band"), _log(i).alias("at"), F.col("chunk").alias("other"), *[F.col(c).alias(f"y_{c}") for c in ("cls", "root", "n", "i")])
        # a set probes its own band of sizes and the next, positions up to what is left, and all chunks, but no cell that its list leaves empty
        x = told.where(room >= 0).withColumn("band", F.explode(F.sequence(band(n), band(n) + 1))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), _log(room))))
        x = x.where(F.col("cells").bitwiseAND(_cell(F.col("band"), F.col("at"))) != 0).drop("cells").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = x.join(y, ["list", "band", "at", "other"])
        smaller = (F.col("n") < F.col("y_n")) | ((F.col("n") == F.col("y_n")) & (F.col("cls") < F.col("y_cls")))
        good = smaller & _placed(n, i, F.col("y_n"), F.col("y_i"), self.num, self.den)
        if not every:
            good = good & (F.col("root") != F.col("y_root"))
        return met.where(good).select(F.col("cls").alias("a"), F.col("y_cls").alias("b"))

    def rest(self, every: bool = False) -> None:
        """All pairs that the rounds left open; with `every`, all pairs."""
        told = self.celled(self.told(), every)
        pairs = self.held(self.untried(self.blocks(self.held(told), every)))
        if not pairs.isEmpty():
            self.link(self.derived(pairs) if self.anchors is not None else self.compared(pairs))
        self.settled()

    def derived(self, pairs: DataFrame) -> DataFrame:
        """Pairs with `common`, from the intersection of their anchors where that decides; the lower bound stands for what links for sure, and what can't link is left out."""
        nearest = self.held(self.anchors.groupBy("cls").agg(F.min("x").alias("x")))
        sides = pairs
        for s in ("a", "b"):
            own = F.struct(F.lit(0).alias("differ"), F.col(s).alias("anchor"), F.col(f"n_{s}").alias("n"), F.col(f"n_{s}").alias("common"))
            sides = sides.join(nearest.select(F.col("cls").alias(s), F.col("x").alias(f"x_{s}")), s, "left").withColumn(f"x_{s}", F.coalesce(f"x_{s}", own))
        sides = self.held(sides)
        # worth while where an anchor stands for another class at least
        key = [F.least("x_a.anchor", "x_b.anchor").alias("p"), F.greatest("x_a.anchor", "x_b.anchor").alias("q")]
        sides = sides.select("*", *key)
        same = F.col("p") == F.col("q")
        bases = self.held(sides.where(~same).groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"))
        self.passing.append(overlaps(bases, self.fetch))
        known = self.passing[-1].select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("common").alias("base"))
        held = sides.join(known, ["p", "q"], "left").withColumn("base", F.when(same, F.col("x_a.n")).otherwise(F.col("base")))
        more = (F.col("n_a") - F.col("x_a.common")) + (F.col("n_b") - F.col("x_b.common"))
        less = (F.col("x_a.n") - F.col("x_a.common")) + (F.col("x_b.n") - F.col("x_b.common"))
        bounded = self.held(held.select("a", "b", "n_a", "n_b", (F.col("base") - less).alias("least"), (F.col("base") + more).alias("most")))
        linked = lambda c: F.coalesce(_linked(F.col(c), F.col("n_a"), F.col("n_b"), self.num, self.den), F.lit(c == "most"))
        sure = bounded.where(linked("least")).select("a", "b", "n_a", "n_b", F.col("least").cast("int").alias("common"))
        unsure = self.held(bounded.where(linked("most") & ~linked("least")).select("a", "b", "n_a", "n_b"))
        return sure.unionByName(self.compared(unsure).select("a", "b", "n_a", "n_b", "common"))


def links(docs: DataFrame, text: str, width: int, num: int, den: int, found: DataFrame) -> DataFrame:
    """node, root: the components of the classes that have any link. `found`: the written classes."""
    state = Join(docs, text, width, num, den, found)
    for turn in range(ROUNDS):
        if not state.round(turn):
            break
    before = state.links
    state.rest()
    dropped(state.sketches)
    if state.links is None:
        return state.entries.select(F.col("cls").alias("node"), F.col("cls").alias("root")).limit(0)
    dropped(state.entries)
    if state.answer is None or state.links is not before:
        state.answer = components(state.links)
    return state.answer


def linked_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The join in full: (key, cls) of each document with words, and (a, b) for each pair of classes that link."""
    found = written(classes(docs, key, text, width))
    state = Join(docs, text, width, num, den, found)
    state.rest(every=True)
    pairs = state.links if state.links is not None else state.entries.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    return found.where("n > 0").select(F.col("key").alias(key), "cls"), pairs


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """A row for each document: key, n_shingles, component_id (the least id that links reach), cls (digest of its set, null if empty)."""
    found = written(classes(docs, key, text, width))
    answer = links(docs, text, width, num, den, found)
    found = found.where("block is null")
    per_class = found.where("n > 0").groupBy("cls").agg(F.min("key").alias("least")).join(answer.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    told = written(per_class.join(least, "root").select("cls", "component_id"))
    rows = found.select("key", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(told, "cls", "left")
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"), "cls")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the least id (null last), then of the least digest of its text.

    Decided by row: an id may have rows in several components, and of rows with one id and one text one stays. Rows without words stay.
    """
    own = F.struct(F.col(f"`{key}`").isNull().alias("unnamed"), F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"), F.xxhash64(f"`{text}`", F.lit(1)).alias("g"))
    told = join(docs.select(own.alias("doc_id"), F.col(f"`{text}`").alias("text")), width=width, num=num, den=den).where("n_shingles > 0")
    counted = told.groupBy("doc_id").agg(F.first("component_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("doc_id") != F.col("kept"), "gone").when(F.col("n") > 1, "repeated")
    told = written(counted.select(F.col("doc_id").alias("_own"), verdict.alias("_verdict")).where("_verdict is not null"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.withColumn("_own", own).join(told, "_own", "left")
    row = F.struct(*columns).alias("_row")
    repeated = held.where("_verdict = 'repeated'").select("_own", row, F.xxhash64(*columns).alias("_h")).groupBy("_own").agg(F.min_by("_row", "_h").alias("_row"))
    return held.where("_verdict is null").select(*columns).unionByName(repeated.select("_row.*"))
