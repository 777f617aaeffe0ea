"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds one row for each
pair of blob and rule version with what the scan found, empty findings included. A scan takes one
copy of each blob that the ledger lacks for the present rules, appends its findings, and joins the
ledger back to every path that holds the blob. All of it is DataFrame operations.

Edge cases: a null text is the empty blob; null and repeated paths each get their row; an empty
table gives an empty result and ledger; any further columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import Kind, all_spans, bracketed, counted, joined, replaced
from ._spark import text_of, written

#: The rules of version 1.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
RULE_VERSION = "base-1"
KINDS = [
    Kind("assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8, lambda t: _any(F.lower(t), ASSIGN_WORDS)),
    Kind("access", ACCESS, lambda v: F.length(v) >= 16, lambda t: F.contains(t, F.lit("AKIA"))),
    Kind("hex", HEX, lambda v: F.lit(True), lambda t: F.rlike(t, F.lit(HEX))),
]
NAMES = [k.name for k in KINDS]
LEDGER = "digest binary, rule_version string, spans array<struct<start:int,kind:int,end:int,value:string>>"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def address(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, fresh): each path with its digest, the ledger with this scan's rows added, and those rows alone."""
    blobs = docs.select(F.col(path).alias("path"), text_of(text).alias("text"), address(text).alias("digest"))
    paths = written(blobs.select("path", "digest"))
    unseen = paths.groupBy("digest").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version).select("digest"), "digest", "left_anti")
    pick, b = unseen.alias("u"), blobs.alias("b")
    once = b.join(pick, F.col("b.path").eqNullSafe(F.col("u.path")) & (F.col("b.digest") == F.col("u.digest")), "left_semi")
    found = once.select("digest", F.lit(version).alias("rule_version"), all_spans(F.col("text"), KINDS).alias("spans"))
    fresh = written(found.dropDuplicates(["digest"]))
    return paths, fresh if ledger is None else ledger.unionByName(fresh), fresh


def findings(paths: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """A row for each path: its counts, the digest of its base spans, and its spans."""
    spans = F.col("spans")
    texts = ledger.where(F.col("rule_version") == version).select("digest", *[counted(spans, i).alias(f"n_{n}") for i, n in enumerate(NAMES)], joined(spans, NAMES, False).alias("spans"))
    return paths.join(texts, "digest").select("path", *[f"n_{n}" for n in NAMES], F.sha2("spans", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, ledger: DataFrame, text: str = "text", size: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """docs with each secret replaced by its kind in brackets; `size` names a column that counts code points."""
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    held = docs.withColumn("_at", address(text)).join(hits, F.col("_at") == F.col("_digest"), "left")
    clean = F.when(F.col("_spans").isNotNull(), replaced(F.col(f"`{text}`"), F.col("_spans"), bracketed(NAMES))).otherwise(F.col(f"`{text}`"))
    held = held.withColumn("_clean", clean)  # a name of its own: inside a lambda, a new column of the same select would hide an old one
    columns = {text: F.col("_clean")} | ({size: F.when(F.col("_spans").isNotNull(), F.length("_clean").cast("long")).otherwise(F.col(f"`{size}`"))} if size else {})
    return held.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
