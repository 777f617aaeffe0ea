"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row x of integer components becomes (x, sqrt(M - |x|**2)), M the largest squared norm, and an anchor a
becomes (a, 0). Then |a - x|**2 = |a|**2 + M - 2 <a, x>: higher scores are nearer, and a window of scores
is an annulus of distances around the anchor. Nearest-first search gives the positives, the first rows of
the anchor's label, and the same search inside the annulus of each positive gives its first rows of other labels.

Vantage points picked from a bounded sample of SAMPLE rows cut space into cells; the rows of a cell, split
by a hash of the id where they are over a block, are the blocks, so that no group is over a bounded size
whatever repeats. Each block's task builds its own tree and answers the anchors that may find something
there: an anchor looks in its own block first, and then only in cells whose distances can hold a better row
(or meet an annulus). Inside a block all anchors go down one tree together: each opens its leaves from the
best bound on, and stops at the first leaf whose bound is under its k-th row. Anchors come in packs, which
bounds the other side of a group; blocks meet each pack apart. Bounds carry a tolerance, scores are exact.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows
that repeat an id, label and vector count once, different rows of one id are each a row, but never
each other's positive or negative; missing components of shorter vectors count as 0; an anchor without positives, or a
positive without a row in its window, gives none; scores beyond a long are cut off at its ends, and are
exact below 2**63. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

#: Rows that the cells' vantage points are picked from, the least of a block and of a leaf, numbers in a block, and anchors in a pack.
SAMPLE, LEAST, LEAF, HELD, PACK = 4096, 512, 64, 1 << 22, 4096
ROW = "akey long, id long, label long, q binary"
LAST = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Vantage points by heap order, the path of each leaf (node, side), the distances between each node's point and its sides' rows, and the rows of each leaf."""

    points: np.ndarray
    paths: list[list[tuple[int, int]]]
    near: np.ndarray
    far: np.ndarray
    leaves: list[np.ndarray]


def _distances(x: np.ndarray, tail: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(((x - x[i]) ** 2).sum(1) + (tail - tail[i]) ** 2)


def build(x: np.ndarray, top: float, levels: int, open_ends: bool = False) -> Tree:
    """A balanced tree over augmented rows: each node's point is the row farthest from the one that lies farthest from the node's first, and halves go by rank. Open ends: distances are those that any row of the side may have, not those of these rows."""
    tail = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    parts, points, bounds, paths = [np.arange(len(x))], [], [], [[]]
    for _ in range(levels):
        halves, ways = [], []
        for rows, path in zip(parts, paths, strict=True):
            if not len(rows):
                node = len(points)
                points.append(np.zeros(x.shape[1]))
                bounds.append(((0.0, np.inf), (0.0, np.inf)))
                halves += [rows, rows]
                ways += [[*path, (node, 0)], [*path, (node, 1)]]
                continue
            own, ends = x[rows], tail[rows]
            v = int(np.argmax(_distances(own, ends, int(np.argmax(_distances(own, ends, 0))))))
            d = _distances(own, ends, v)
            order = np.argsort(d, kind="stable")
            cut = (len(rows) + 1) // 2
            inside, outside = rows[order[:cut]], rows[order[cut:]]
            edge = d[order[cut - 1]]
            if open_ends:
                bounds.append(((0.0, edge), (edge, np.inf)))
            else:
                bounds.append(((d[order[0]], edge), (d[order[cut]], d[order[-1]]) if len(outside) else (np.inf, np.inf)))
            node = len(points)
            points.append(own[v])
            halves += [inside, outside]
            ways += [[*path, (node, 0)], [*path, (node, 1)]]
        parts, paths = halves, ways
    b = np.array(bounds, float).reshape(-1, 2, 2)
    return Tree(np.array(points, float).reshape(len(points), x.shape[1]), paths, b[..., 0], b[..., 1], parts)


def place(tree: Tree, x: np.ndarray, top: float) -> np.ndarray:
    """The leaf of a tree with open ends that each row belongs to."""
    tail = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    v = np.sqrt(np.maximum(top - (tree.points**2).sum(1), 0))
    at, node, level = np.zeros(len(x), int), np.zeros(len(x), int), 1
    while level < len(tree.paths):
        d = np.sqrt(((x - tree.points[node]) ** 2).sum(1) + (tail - v[node]) ** 2)
        at = 2 * at + (d > tree.far[node, 0])
        node, level = 2 * level - 1 + at, 2 * level
    return at


def bounds(tree: Tree, a: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the least score that each leaf can give each anchor."""
    whole = (a * a).sum(1) + top
    d = np.sqrt(np.maximum(whole[:, None] - 2 * (a @ tree.points.T), 0)) if len(tree.points) else np.zeros((len(a), 0))
    low, high = np.zeros((len(a), len(tree.paths))), np.full((len(a), len(tree.paths)), np.inf)
    for leaf, path in enumerate(tree.paths):
        for node, side in path:
            low[:, leaf] = np.maximum(low[:, leaf], np.maximum(d[:, node] - tree.far[node, side], tree.near[node, side] - d[:, node]))
            high[:, leaf] = np.minimum(high[:, leaf], d[:, node] + tree.far[node, side])
    slack = 1e-6 * (whole[:, None] + 1)
    with np.errstate(invalid="ignore"):
        return (whole[:, None] - low**2) / 2 + slack, (whole[:, None] - high**2) / 2 - slack


def scores(a: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of integers."""
    if top < 1 << 52:
        return (a @ x.T).astype(np.int64)
    wide = a.astype(np.longdouble) @ x.astype(np.longdouble).T  # 64 bits of mantissa
    out = np.full(wide.shape, LAST)
    out[wide <= -(2.0**63)] = -LAST - 1
    inside = np.abs(wide) < 2.0**63
    out[inside] = wide[inside].astype(np.int64)
    return out


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: float, a: np.ndarray, own: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of each anchor's first k rows of its label (or of others) with a score from low to high; -1 in the id's place where there are fewer, marked by a score of the least long.

    Leaves are opened nearest first, from the annulus' outer score down.
    """
    most, least = bounds(tree, a, top)
    best = np.minimum(most, high[:, None])
    best[(most < low[:, None]) | (least > high[:, None])] = -np.inf
    order = np.argsort(-best, 1, kind="stable")
    found, got = np.full((len(a), k), -LAST - 1), np.full((len(a), k), LAST)
    for turn in range(len(tree.leaves)):
        leaf = order[:, turn]
        bound = best[np.arange(len(a)), leaf]
        # equal bounds may hold smaller ids
        open_ = np.flatnonzero((bound > -np.inf) & (bound >= found[:, -1]))
        if not len(open_):
            break
        for at in np.unique(leaf[open_]):
            rows, who = tree.leaves[at], open_[leaf[open_] == at]
            if not len(rows):
                continue
            s = scores(a[who], x[rows], top)
            fits = ((labels[rows] == of[who][:, None]) == same) & (ids[rows] != own[who][:, None]) & (s >= low[who][:, None]) & (s <= high[who][:, None])
            s, i = np.where(fits, s, -LAST - 1), np.where(fits, ids[rows], LAST)
            s, i = np.hstack([found[who], s]), np.hstack([got[who], i])
            first = np.lexsort((i, -s.astype(np.longdouble) if top >= 1 << 52 else -s.astype(float)), axis=1)[:, :k]
            found[who], got[who] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return got, found


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        v = np.frombuffer(v, "<f8")
        out[i, : len(v)] = v
    return out


def whole(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """akey (of the row's values), id, label, q (components floor(scale x), as bytes), norm."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, off = lists.values, lists.offsets.to_numpy()
            x = values.to_numpy(zero_copy_only=False).astype(float)  # null is nan
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = np.flatnonzero(bad[off[1:]] == bad[off[:-1]])
            q = np.floor(scale * np.where(np.isfinite(x), x, 0.0))
            rows = [q[off[i] : off[i + 1]] for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary()), pa.array([float(r @ r) for r in rows], pa.float64())], ["id", "label", "q", "norm"])

    plain = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    known = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    out = known.mapInArrow(read, "id long, label long, q binary, norm double")
    return out.select(F.xxhash64("id", "label", "q").alias("akey"), "*")


def _celled(rows: DataFrame, tree: Tree, top: float, width: int) -> DataFrame:
    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(tree, _vectors(batch.column(3), width), top)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["akey", "id", "label", "q", "cell"])

    return rows.select("akey", "id", "label", "q").mapInArrow(cell, f"{ROW}, cell int")


@dataclass
class Blocks:
    """Rows with cell and block, the cells' tree, the first block and the number of blocks of each cell, and the bounds on norms and widths."""

    rows: DataFrame
    tree: Tree
    first: np.ndarray
    count: np.ndarray
    top: float
    width: int
    leaf: int


def index(rows: DataFrame, sample: int = SAMPLE, least: int = LEAST, leaf: int = LEAF) -> Blocks:
    """Rows (of `whole`, written) in blocks. The driver sees the sample, one row of bounds and one row a cell."""
    n, top, size = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.length("q"))).first()
    top, width = float(top or 0), max(1, (size or 0) // 8)
    block = max(1, min(max(least, n // 64), HELD // width))
    picked = rows.select("akey", "q").orderBy(F.xxhash64("akey"), "akey").limit(sample).collect()
    x = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        v = np.frombuffer(r.q, "<f8")
        x[i, : len(v)] = v
    levels = min(max(0, round(np.log2(max(1, n / block)))), max(0, int(np.log2(max(1, len(x) / 8)))))
    tree = build(x, top, levels, open_ends=True)
    celled = written(_celled(rows, tree, top, width))
    sizes = np.zeros(len(tree.paths), int)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.cell] = r.n
    count = np.maximum(1, -(-sizes // block))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    of = lambda v: F.element_at(F.lit(v.tolist()), F.col("cell") + 1)
    placed = celled.withColumn("block", (of(first) + F.pmod(F.xxhash64("id"), of(count))).cast("int"))
    return Blocks(placed, tree, first, count, top, width, leaf)


def _asked(b: Blocks, anchors: DataFrame, windows: bool, elsewhere: bool) -> DataFrame:
    """anchors (ROW, cell, block, low, high: lists of a score window each) for each block that may hold a row of a window; elsewhere: not for their own block. low is the least score that still counts."""
    names = ["akey", "id", "label", "q", "low", "high", "block"]
    tree, top, width, first, count = b.tree, b.top, b.width, b.first, b.count

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                most, least = bounds(tree, _vectors(part.column(3), width), top)
                who, where = [], []
                for i, (own, low, high) in enumerate(zip(part.column(6).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)):
                    fits = np.zeros(len(count), bool)
                    for one, other in zip(low, high, strict=True):
                        fits |= (most[i] >= one) & (least[i] <= other)
                    at = np.concatenate([np.arange(first[c], first[c] + count[c]) for c in np.flatnonzero(fits)] or [np.zeros(0, int)])
                    at = at[at != own] if elsewhere else at
                    who += [i] * len(at)
                    where += at.tolist()
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(take) for k in range(6)], pa.array(where, pa.int32())], names)

    return anchors.select(*names).mapInArrow(ask, f"{ROW}, low array<long>, high array<long>, block int")


def _answers(b: Blocks, asked: DataFrame, packs: int, k: int, same: bool) -> DataFrame:
    """akey, window (its place in the lists), found, score: each block's first k rows of each window."""
    top, width, leaf = b.top, b.width, b.leaf

    def answer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names, kinds = ["akey", "window", "found", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not rows.num_rows or not asks.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        rows = rows.sort_by([("id", "ascending"), ("akey", "ascending")])
        keys = rows["akey"].to_numpy()
        once = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1])))  # equal rows have one key and one place
        x, ids, labels = _vectors(rows["q"].combine_chunks(), width)[once], rows["id"].to_numpy()[once], rows["label"].to_numpy()[once]
        tree = build(x, top, max(0, int(np.ceil(np.log2(max(1, len(x) / leaf))))))
        low, high = asks["low"].to_pylist(), asks["high"].to_pylist()
        who = np.repeat(np.arange(len(low)), [len(v) for v in low])
        a = _vectors(asks["q"].combine_chunks(), width)
        got, score = search(tree, x, ids, labels, top, a[who], asks["id"].to_numpy()[who], asks["label"].to_numpy()[who], np.array(sum(low, []), np.int64), np.array(sum(high, []), np.int64), k, same)
        window = np.concatenate([np.arange(len(v)) for v in low]) if low else np.zeros(0, int)
        at, place = np.nonzero(got != LAST)
        values = [asks["akey"].to_numpy()[who[at]], window[at].astype(np.int32), got[at, place], score[at, place]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    pack = F.pmod(F.xxhash64("akey"), F.lit(packs)).cast("int")
    left = b.rows.select("akey", "id", "label", "q", "block", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))
    right = asked.withColumn("pack", pack)
    return left.groupBy("block", "pack").cogroup(right.groupBy("block", "pack")).applyInArrow(answer, "akey long, window int, found long, score long")


def _first(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "found"))).where(F.col(name) <= k)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **sizes) -> DataFrame:
    """anchor, positive, rank, negative, positive_score, negative_score: of each anchor (a condition on the key, as `id`) and each of its first rows of its label, the first rows of other labels with a score of low to high per cent of the positive's."""
    b = index(written(whole(df, key, vector, F.col("label") if label is None else label, scale)), **sizes)
    anchors = written(b.rows.where(anchor).dropDuplicates(["akey"]).withColumns({"low": F.array(F.lit(-LAST)), "high": F.array(F.lit(LAST))}))
    packs = max(1, -(-anchors.count() // PACK))
    near = written(_answers(b, anchors, packs, positives, True))
    reach = near.groupBy("akey").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= positives).select("akey", "least")
    rest = anchors.join(reach, "akey", "left").withColumn("low", F.array(F.coalesce("least", F.lit(-LAST)))).drop("least")
    far = _answers(b, _asked(b, rest, False, True), packs, positives, True)
    best = written(_first(near.unionByName(far), ["akey"], positives, "place").select("akey", F.col("found").alias("positive"), F.col("score").alias("positive_score"), "place"))
    share = lambda part: F.col("positive_score").cast("decimal(20,0)") * F.lit(part).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    floor, ceiling = F.ceil(share(low)).cast("long"), F.floor(share(high)).cast("long")
    windows = best.withColumns({"low": floor, "high": ceiling}).where("low <= high")
    lists = windows.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # a few
    asked = anchors.drop("low", "high").join(lists, "akey").withColumns({"low": F.col("w.low"), "high": F.col("w.high")})
    found = _answers(b, _asked(b, asked, True, False), packs, negatives, False)
    numbered = lists.select("akey", F.posexplode("w").alias("window", "x")).select("akey", "window", F.col("x.place").alias("place"))
    ranked = _first(found, ["akey", "window"], negatives, "rank").join(numbered, ["akey", "window"]).join(best, ["akey", "place"]).join(anchors.select("akey", F.col("id").alias("anchor")), "akey")
    return ranked.select("anchor", "positive", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative"), "positive_score", F.col("score").alias("negative_score"))
