"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (up to three sentences of a line) are digested to 64 bits, and the distinct
digests go to one cell in each of three subtables of a sketch: a count, the XOR of the digests and
the XOR of their checks. The sketch of a text is its fingerprint. Two versions' sketches subtract
cell by cell, what they share cancels, and peeling recovers the digests that differ: a cell with
a single digest names it, and taking it out of its other cells bares more. Each peeling step is an
aggregation, and all steps of an attempt run on one partitioning. The first attempt peels the
difference of the fingerprints themselves. What fails to peel is tried again with sketches four times
as large and other cells, until nothing fails.

Likeness is the share of common digests among all digests of the two texts, from the recovered
difference and the two set sizes. Equal texts have equal fingerprints.

For versions by place, documents are dealt into ranges of the id, whose last row meets the first
of the next range by a copy of that row; no document crosses the cluster but once.

Edge cases: a null text is empty (no paragraphs; two empty texts are alike: 1); rows with equal
ids follow each other in order of their text's hash, rows with a null id come last; a sole row is its own next;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import text_of, written

#: Fixed value: a paragraph.
PARAGRAPH = r"(?:[^\n.!?]*+[.!?]++[ ]?+|[^\n.!?]++){1,3}"
#: Cells in each of the three subtables of a fingerprint, growth on failure, and peeling steps to an attempt.
CELLS, GROWTH, STEPS = 8, 4, 12
#: Cells to a partition, and the most ranges of the id.
PART_CELLS, RANGES = 500_000, 1 << 13
CHECK = 0x5EED


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(key: Column, subtable: int, cells: int, seed: int) -> Column:
    h = F.xxhash64(key, F.lit(seed))
    return (F.shiftrightunsigned(h, 20 * subtable).bitwiseAND(F.lit(cells - 1)) + subtable * cells).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def _cells(elements: DataFrame, by: list[str], cells: int, seed: int) -> DataFrame:
    """Sketches, one row for each cell: `by`, cell, n, key, check; from elements `by`, key, n."""
    spread = elements.select(*by, "key", "n", F.explode(F.array(*[_cell(F.col("key"), j, cells, seed) for j in range(3)])).alias("cell"))
    return _summed(spread.select(*by, "cell", "n", "key", _check(F.col("key")).alias("check")), by)


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    total = rows.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return total.where((F.col("n") != 0) | (F.col("key") != 0) | (F.col("check") != 0))


def _peel(sketch: DataFrame, by: list[str], subtable: int, cells: int, seed: int) -> DataFrame:
    """Take out the digests that are alone in a cell of one subtable. Cells -1 and -2 count what was recovered of either side."""
    key, n = F.col("key"), F.col("n")
    alone = F.col("cell").between(subtable * cells, (subtable + 1) * cells - 1) & (F.abs(n) == 1) & (F.col("check") == _check(key))

    def cell(at: Column, count: Column, key: Column, check: Column) -> Column:
        return F.struct(at.alias("cell"), count.cast("long").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))

    others = [cell(_cell(key, j, cells, seed), -n, key, F.col("check")) for j in range(3) if j != subtable]
    gone = F.array(*others, cell(F.when(n > 0, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1), F.lit(0), F.lit(0)))
    kept = F.array(cell(F.col("cell"), n, key, F.col("check")))
    return _summed(sketch.select(*by, F.explode(F.when(alone, gone).otherwise(kept)).alias("c")).select(*by, "c.*"), by)


def _parts(rows: DataFrame, cells: int) -> int:
    """Partitions for sketches of the rows: each of some hundred thousand cells at most, where the default number gives more."""
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(default, -(-rows.count() * 3 * cells // PART_CELLS))


def difference(pairs: DataFrame, cells: int, seed: int, steps: int = STEPS, left: DataFrame | None = None) -> DataFrame:
    """One attempt on (id, pair, one, other), or on those of the pairs that are `left` (id, pair): id, pair, differ, failed. A pair without a row does not differ.

    What is left meets the pairs where they are peeled, by id, so that the digests move once.
    """
    by = ["id", "pair"]
    signed = F.concat(F.transform("one", lambda k: F.struct(k.alias("key"), F.lit(1).alias("n"))), F.transform("other", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("n"))))
    dealt = pairs.repartition(_parts(pairs if left is None else left, cells), "id")
    if left is not None:
        dealt = dealt.join(left.groupBy("id").agg(F.collect_set("pair").alias("_left")), "id").where(F.array_contains("_left", F.col("pair")))
    elements = dealt.select(*by, F.explode(signed).alias("x")).select(*by, "x.*")
    sketch = _cells(elements, by, cells, seed)
    for step in range(steps):
        sketch = _peel(sketch, by, step % 3, cells, seed)
    recovered = F.sum(F.when(F.col("cell") < 0, F.col("n")).otherwise(0))
    return sketch.groupBy(*by).agg(recovered.alias("differ"), F.max(F.col("cell") >= 0).alias("failed"))


def differences(pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Sizes of the differences of all pairs: id, pair, differ. `pairs` reads a written table.

    The first attempt peels the difference of the two fingerprints; what fails is tried again, larger.
    """
    done, failed, size, seed = None, None, cells, 0
    while True:
        tried = written(difference(pairs, size, seed, left=failed))
        peeled = tried.where(~F.col("failed")).select("id", "pair", "differ")
        done = peeled if done is None else done.unionByName(peeled)
        failed = tried.where("failed").select("id", "pair")
        if failed.isEmpty():
            return done
        size, seed = size * GROWTH, seed + 1


def likeness(n: Column, differ: Column) -> Column:
    """Common digests among all, from the sum of the set sizes and the size of the difference; 1 if there are none."""
    return F.when(n == 0, F.lit(1.0)).otherwise((n - differ) / (n + differ))


def fingerprints(texts: DataFrame, cells: int = CELLS) -> DataFrame:
    """Fingerprints of (id, side, digests): id, side, fingerprint: set size, and count, key and check of each cell that is not empty."""
    elements = texts.repartition(_parts(texts, cells), "id").select("id", "side", F.explode("digests").alias("key"), F.lit(1).alias("n"))
    hexed = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("key"), F.hex(F.col("check").bitwiseAND(F.lit(0xFFFFFFFF))))
    cells_of = _cells(elements, ["id", "side"], cells, 0).groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("cell", hexed.alias("hexed")))).alias("cells"), F.sum("n").alias("n"))
    return cells_of.select("id", "side", F.concat_ws(";", F.hex((F.col("n") / 3).cast("long")), F.concat_ws(",", F.transform("cells", lambda c: c["hexed"]))).alias("fingerprint"))


def in_id_order(docs: DataFrame, key: str, text: str, per_range: int = 2048) -> DataFrame:
    """Each row with the next in descending order of the id, the first after the last: key, text, next, digests, next_digests."""
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("most")).first()
    held = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    bounds: list[int] = []
    if sizes.most is not None:
        ranges = max(1, min(RANGES, sizes.n // per_range))
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first().b if shares else []
        bounds = sorted({*found, sizes.most})
    top = len(bounds) - 1
    width = 1 << max(1, len(bounds)).bit_length()
    padded = F.lit([*bounds, *[(1 << 63) - 1] * (width - len(bounds))])
    halves = F.lit([width >> i for i in range(1, width.bit_length())])
    # the number of bounds under the id, by halving
    bucket = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(padded, at + half - 1) < F.col("key"), at + half).otherwise(at))
    ranged = held.withColumn("bucket", F.when(F.col("key").isNull(), 0).otherwise(bucket).cast("int"))
    at = F.col("bucket")
    copy = F.when(F.col("key") == F.get(padded, at), F.array(F.struct(at.alias("bucket"), F.lit(0).alias("copy")), F.struct(F.when(at == top, 0).otherwise(at + 1).alias("bucket"), F.when(at == top, 2).otherwise(1).alias("copy"))))
    dealt = ranged.select("key", "text", F.explode(F.coalesce(copy, F.array(F.struct(at.alias("bucket"), F.lit(0).alias("copy"))))).alias("to")).select("key", "text", "to.*")
    dealt = dealt.repartition("bucket").withColumn("digests", paragraphs(F.col("text")))  # digests are made where they are met, and not moved
    order = Window.partitionBy("bucket").orderBy(F.col("copy") == 2, F.col("key").desc_nulls_last(), F.xxhash64("text"), "copy")
    follow = dealt.select("key", "text", "digests", "copy", F.lead("text").over(order).alias("next"), F.lead("digests").over(order).alias("next_digests"))
    return follow.where(F.col("copy") == 0).select("key", "text", "digests", F.coalesce("next", "text").alias("next"), F.coalesce("next_digests", "digests").alias("next_digests"))


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and its likeness to that and to the next document."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    follow = in_id_order(docs, key, text)
    edited = follow.select("key", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"), "digests", "next_digests")
    rows = written(edited.select(F.monotonically_increasing_id().alias("id"), "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", paragraphs(F.col("edited")).alias("edited_digests"), "next_digests"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("digests")), F.struct(F.lit(1).alias("side"), F.col("edited_digests").alias("digests")))
    prints = fingerprints(rows.select("id", F.explode(sides).alias("s")).select("id", "s.*"))
    prints = prints.groupBy("id").agg(*[F.max(F.when(F.col("side") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))])
    both = F.array(F.struct(F.lit(0).alias("pair"), F.col("edited_digests").alias("other")), F.struct(F.lit(1).alias("pair"), F.col("next_digests").alias("other")))
    differ = differences(rows.select("id", F.col("digests").alias("one"), F.explode(both).alias("p")).select("id", "p.pair", "one", "p.other"))
    differ = differ.groupBy("id").agg(*[F.max(F.when(F.col("pair") == i, F.col("differ"))).alias(f"differ_{i}") for i in (0, 1)])
    sized = rows.select("id", "key", "n_chars", "edited_sha256", (F.size("digests") + F.size("edited_digests")).alias("n_0"), (F.size("digests") + F.size("next_digests")).alias("n_1"))
    whole = sized.join(prints, "id", "left").join(differ, "id", "left")
    none = F.lit("0;")
    return whole.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", none).alias("fingerprint"),
        F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"),
        likeness(F.col("n_0"), F.coalesce("differ_0", F.lit(0))).alias("near_edited"),
        likeness(F.col("n_1"), F.coalesce("differ_1", F.lit(0))).alias("near_next"),
    )
