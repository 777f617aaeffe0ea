"""Personal data, and the terms that disclose it: information-theoretic sanitisation.

Protected entities are the base spans: mail addresses, IPv4 addresses, card and phone numbers. A
term (a run of letters, outside of mail addresses) discloses an entity as far as the corpus ties the
two: PMI(entity, term) / IC(entity), from counts of whole documents, is 1 if the term occurs only in
documents with the entity. Terms at or over `remove` are to be removed, those at or over
`generalise` to be replaced by a general word: the one that tells most of the same entity and stays
under `generalise`, where the corpus has one. A term is marked wherever it occurs, with the entity
or without it. A pair must occur together in `support` distinct texts; with 1, a sole document
ties all its rare words to its entities.

Counts cover the whole corpus. The ratio reaches `generalise` only if the term's documents are at most
n_ct * (n / n_c) ** (1 - generalise); terms of which the documents with entities hold more already are
left out before the rest of the corpus is counted. A bit set of fixed size of the terms that are left
spares other words the way to that count; once it is full it merely spares none.

Edge cases: a null text is empty; rows with null or repeated ids each get their row; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import Kind, all_spans, bracketed, counted, joined, let, replaced, spans_of
from ._spark import text_of, written

#: The base patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]|)"
IP_HOLDS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}++"
#: Longs in a bit set.
BITS_LONGS = 1 << 16


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.split(F.reverse(_digits(v)), "")
    values = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


KINDS = [
    Kind("email", EMAIL, lambda v: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", IP, lambda v: F.rlike(v, F.lit(IP_HOLDS)), lambda t: F.rlike(t, F.lit(IP))),
    Kind("card", CARD, lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(v)).otherwise(F.lit(False)), lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}"))),
    Kind("phone", PHONE, lambda v: F.length(_digits(v)).between(8, 15), lambda t: F.contains(t, F.lit("+"))),
]
BASE = [k.name for k in KINDS]
NAMES = [*BASE, "removed", "generalised"]


def _entity(span: Column) -> Column:
    """What the span names: its kind and its value, whatever the case or the separators."""
    return F.concat_ws(":", span["kind"].cast("string"), F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"])))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), F.lower))


class Bits:
    """A bit set of fixed size of the hashes of a column's values, as a scalar."""

    def __init__(self, rows: DataFrame, column: str):
        h = F.xxhash64(column)
        filled = rows.select(self._slot(h).alias("at"), h.alias("h")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
        dense = rows.sparkSession.range(BITS_LONGS).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
        self.bits = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits")).scalar()

    @staticmethod
    def _slot(h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITS_LONGS - 1)).cast("int")

    def has(self, column: str) -> Column:
        h = F.xxhash64(column)
        return F.getbit(F.get(self.bits, self._slot(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def disclosing(held: DataFrame, base: DataFrame, remove: float, generalise: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(term, ratio, word) of the terms to be marked, word being null where a term is to be removed or no general word is known; (blob, term) of texts that hold candidates."""
    texts = written(base.where(F.size("entities") > 0).groupBy("blob").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("copies")))
    of_entity = texts.select("terms", "copies", F.explode("entities").alias("entity"))
    n_c = written(of_entity.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("entity", "n_c"))
    met = of_entity.join(n_c.select("entity"), "entity", "left_semi").select("entity", "copies", F.explode("terms").alias("term"))
    n_ct = met.groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("entity", "term", "n_ct")
    n_e = texts.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_e"))
    n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    most = F.col("n_ct") * F.pow(F.col("n") / F.col("n_c"), F.lit(1 - generalise)) * (1 + 1e-9)
    cand = n_ct.join(n_c, "entity").join(n_e, "term").withColumn("n", n).where((F.col("n") > F.col("n_c")) & (F.col("n_e") <= most)).drop("n_e")
    cand = written(cand)

    likely = Bits(cand.select("term").distinct(), "term")
    holding = written(held.select("blob", F.explode(_terms(F.col("text"))).alias("term")).where(likely.has("term")))
    n_t = holding.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    ratio = F.log(F.col("n") * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.log(F.col("n") / F.col("n_c"))
    scored = written(cand.join(n_t, "term").select("entity", "term", "n_t", ratio.alias("ratio")))
    word = scored.where(F.col("ratio") < generalise).groupBy("entity").agg(F.max_by("term", F.struct("ratio", "n_t", "term")).alias("word"))
    tied = scored.where(F.col("ratio") >= generalise).join(word, "entity", "left")
    tied = tied.groupBy("term").agg(F.max(F.struct("ratio", "word")).alias("x"))
    return written(tied.select("term", "x.ratio", F.when(F.col("x.ratio") < remove, F.col("x.word")).alias("word"))), holding


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = 0.9, generalise: float = 0.7, support: int = 2) -> DataFrame:
    """A row for each document: key, base and spans array<struct<start, kind, end, word>>, the latter with disclosing terms (kind: place in NAMES; word: the general word, or null)."""
    held = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    base = held.select("key", "blob", "text", all_spans(F.col("text"), KINDS).alias("spans"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("string").alias("word")))
    entities = F.array_distinct(F.transform("spans", _entity))
    base = written(base.select("key", "blob", plain.alias("base"), entities.alias("entities"), F.when(F.size("spans") > 0, _terms(F.col("text"))).alias("terms")))
    tied, holding = disclosing(held, base, remove, generalise, support)

    told = holding.join(tied, "term").groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("term", F.struct("ratio", "word")))).alias("told"))
    told = written(told)
    some = Bits(told, "blob")
    texts = held.where(some.has("blob")).groupBy("blob").agg(F.first("text").alias("text")).join(told, "blob")
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), lambda w: F.map_contains_key("told", F.lower(w)))
    texts = texts.select("blob", "text", "told", F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})")).alias("pattern"))

    def mark(t: Column) -> Column:
        return let(F.element_at("told", F.lower(t["value"])), lambda x: F.struct(t["start"].alias("start"), F.when(x["ratio"] >= remove, len(BASE)).otherwise(len(BASE) + 1).alias("kind"), t["end"].alias("end"), x["word"].alias("word")))

    marks = written(texts.select("blob", F.transform(spans_of(F.col("text"), F.col("pattern")), mark).alias("marks")))
    apart = F.filter("marks", lambda t: ~F.exists("base", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return base.join(marks, "blob", "left").select("key", "base", F.concat("base", F.coalesce(apart, F.array().cast("array<struct<start:int,kind:int,end:int,word:string>>"))).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        F.col("key").alias(key),
        *[counted(F.col("base"), i).alias(f"n_{n}") for i, n in enumerate(BASE)],
        F.sha2(joined(F.col("base"), NAMES, True), 256).alias("base_sha256"),
        joined(F.col("spans"), NAMES, True).alias("spans"),
    )


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its general word, or else by its kind in brackets."""
    label = bracketed(NAMES)
    return replaced(text, spans, lambda s: F.coalesce(s["word"], label(s)))
