"""Conversation prefix trie, family first.

A family is the conversations that share a base conversation (id minus its remainder by 5). Each is
rebuilt from the base's first turns and its own later ones; its prefixes are the nodes of the
family's trie. Only the nodes of each family, combined, cross the cluster to be merged into the
trie of all conversations: an id, counts and digests, never a text.

A turn is its place in the rebuilt conversation, a 128-bit digest of (role, text) and its bytes; a
prefix is its depth and the exclusive or of the digests of its (place, turn), so that a prefix's
parent is had by taking its last turn out again, and prefixes of one conversation come from a scan
in pieces, whatever its length. Two different sequences of one depth meet in a digest with a chance
of about n**2 / 2**129 for n nodes (10**-19 for 10**10).

Sums over subtrees need no walk over levels: each node is owned by its smallest member, an owner's
nodes are the lower end of its own path, and what a member adds to a node's subtree is the sum of
the nodes that it owns at that depth and below. So a node's sum is its owner's from there on, and
the whole sums of its other members, which one aggregation by node gives.

Edge cases: rows without a conversation id belong to none; null roles and texts are empty; turns are
ordered by turn, null first, equal ones by role, then by the digest of the text; repeated rows are
turns like others; an absent base gives no turns; a conversation may end up turnless and then ends at
the root; no conversations, no nodes. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ._spark import written

#: Ids in one string of a node's ends; turns in one piece of a conversation.
CHUNK, PIECE = 1024, 1024
FAMILY, HEADS = 5, 9
NODE = ["depth", "x1", "x2"]


def head_of(conv: Column, heads: int = HEADS) -> Column:
    """How many turns of its base a conversation takes."""
    return (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int")


def rebuilt(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """base, conv, depth, t1, t2, bytes, source, at: each turn of each rebuilt conversation, and where it stands in which original one; a row of depth 0 for each conversation."""
    c, said = F.col(conv).cast("long"), [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    digest = [F.xxhash64(F.lit(k), *said).alias(f"d{k}") for k in (1, 2)]
    plain = turns.where(c.isNotNull()).select(c.alias("conv"), F.col(order).alias("turn"), said[0].alias("role"), *digest, F.octet_length(said[1]).cast("long").alias("bytes"))
    sequence = [F.col("turn").asc_nulls_first(), "role", "d1", "d2"]
    own = scans.numbered(plain, scans.bucket_of(F.col("turn"), PIECE), sequence, "at", keys=("conv",), start=1).withColumn("base", F.col("conv") - F.col("conv") % family)
    first = own.where((F.col("conv") == F.col("base")) & (F.col("at") < heads)).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("at", "d1", "d2", "bytes"))).alias("head"))  # heads - 1 turns at most
    each = own.groupBy("conv").agg(F.first("base").alias("base")).join(first, "base", "left")
    none = F.array().cast(first.schema["head"].dataType)
    taken = F.slice(F.coalesce("head", none), 1, head_of(F.col("conv"), heads))
    each = each.select("base", "conv", head_of(F.col("conv"), heads).alias("h"), taken.alias("head"))
    root = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("at", "d1", "d2", "bytes")])
    tops = each.select("base", "conv", F.explode(F.concat(F.array(root), "head")).alias("t"))
    tops = tops.select("base", "conv", F.col("t.at").alias("depth"), "t.d1", "t.d2", "t.bytes", F.col("base").alias("source"), F.col("t.at").alias("at"))
    later = own.join(each.select("conv", "h", F.size("head").alias("n")), "conv").where("at > h").select("base", "conv", (F.col("n") + F.col("at") - F.col("h")).alias("depth"), "d1", "d2", "bytes", F.col("conv").alias("source"), "at")
    salted = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "d1", "d2")).otherwise(F.lit(0).cast("long")).alias(f"t{k}") for k in (1, 2)]
    return tops.unionByName(later).select("base", "conv", "depth", *salted, "bytes", "source", "at")


def prefixes(turns: DataFrame) -> DataFrame:
    """rebuilt rows with x1, x2 (the prefix that ends there) and ends (whether the conversation does)."""
    sized = turns.groupBy("conv").agg(F.max("depth").alias("_length"))
    out = scans.along(turns, scans.bucket_of(F.col("depth"), PIECE), ["depth"], keys=("conv",), xors={"x1": F.col("t1"), "x2": F.col("t2")})
    return out.join(sized, "conv").withColumn("ends", F.col("depth") == F.col("_length")).drop("_length")


def families(paths: DataFrame) -> DataFrame:
    """The nodes of each family's trie: base, node, parent (p1, p2), conv (smallest member), n, bytes."""
    return paths.groupBy("base", *NODE).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"), F.first("t1").alias("t1"), F.first("t2").alias("t2"))


def merged(nodes: DataFrame) -> DataFrame:
    """The nodes of the whole trie, with n_children and their parents' digests p1, p2."""
    whole = nodes.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("bytes").alias("bytes"), F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    whole = written(whole.select("*", F.col("x1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("t2")).alias("p2")).drop("t1", "t2"))
    children = whole.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    return whole.join(children, NODE, "left").na.fill(0, ["n_children"])


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, x1, x2, ids in order of node and chunk -> the SHA-256 of each node's ids, which goes on over batches."""
    key, state = None, None

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)], [*NODE, "ends_sha256"])

    for part in parts:
        done = []
        for *node, ids in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if node != key:
                if state is not None:
                    done.append([*key, state.hexdigest()])
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield out(done)
    if state is not None:
        yield out([[*key, state.hexdigest()]])


def ends(paths: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids that end at each node. Ids go in strings of CHUNK by their ranges, then a node's strings pass one task as a stream, since the digest is a chain; it holds one batch."""
    chunk = F.floor(F.col("conv") / CHUNK)
    strings = paths.where("ends").groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = strings.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return ordered.select(*NODE, "ids").mapInArrow(_hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths): nodes with depth, x1, x2, conv, parent, n_convs, n_children, n_leaves, saved, ends_sha256; paths as of `prefixes`."""
    paths = written(prefixes(rebuilt(conversations, **names)))
    nodes = written(merged(families(paths)))
    worth = nodes.select("conv", *NODE, ((F.col("n") - 1) * F.col("bytes")).alias("v"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    whole = worth.groupBy("conv").agg(F.sum("v").alias("tv"), F.sum("leaf").alias("tl"))
    before = scans.along(worth, scans.bucket_of(F.col("depth"), PIECE), ["depth"], keys=("conv",), sums={"sv": F.col("v"), "sl": F.col("leaf")})
    # an owner's part of its own node is less by what it owns above: what it owns in all is added below, for each member
    above = before.select(*NODE, (F.col("v") - F.col("sv")).alias("tv"), (F.col("leaf") - F.col("sl")).alias("tl"))
    members = paths.select("base", "conv", *NODE).join(whole, "conv").groupBy("base", *NODE).agg(F.sum("tv").alias("tv"), F.sum("tl").alias("tl"))
    sums = members.drop("base").unionByName(above).groupBy(*NODE).agg(F.sum("tv").alias("saved"), F.sum("tl").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent"))
    out = nodes.join(parents, ["depth", "p1", "p2"], "left").join(sums, NODE).join(ends(paths), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*NODE, "conv", "parent", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), paths


def digest(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def texts(nodes: DataFrame, paths: DataFrame, conversations: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """nodes with the role and text of their last turns, as they stand in the conversations; the root has none."""
    c, said = F.col(conv).cast("long"), [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    plain = conversations.where(c.isNotNull()).select(c.alias("source"), F.col(order).alias("turn"), said[0].alias("role"), said[1].alias("text"), *[F.xxhash64(F.lit(k), *said).alias(f"d{k}") for k in (1, 2)])
    own = scans.numbered(plain, scans.bucket_of(F.col("turn"), PIECE), [F.col("turn").asc_nulls_first(), "role", "d1", "d2"], "at", keys=("source",), start=1).select("source", "at", "role", "text")
    met = nodes.join(paths.select("conv", "depth", "source", "at"), ["conv", "depth"])
    return met.join(own, ["source", "at"], "left").drop("source", "at")
