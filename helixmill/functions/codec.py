"""Sequence encoding: symbols, complements, seeds, packing and mismatch counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols by code (bits 1 and 2 of the character), lengths, costs and bounds.
SYMBOLS = "ACTG"
READ, SEED, NEIGHBOUR = 120, 14, 104
SUBSTITUTION, MAX_SCORE = 10, 40
CHUNK = 500
#: Characters 1 to 255 and the symbols that the code formula gives them.
CHARACTERS = "".join(map(chr, range(1, 256)))
TEXT_CODES = "".join(SYMBOLS[(c >> 1) & 3] for c in range(1, 256))


def encode_text(text: Column) -> Column:
    """Any text as symbols; what the code formula has no byte for is unknown, N."""
    return F.regexp_replace(F.translate(text, CHARACTERS, TEXT_CODES), "[^ACTG]", "N")


def encode_reference(line: Column) -> Column:
    """Reference symbols: N stays unknown, all else follows the code formula."""
    return F.regexp_replace(F.translate(line, CHARACTERS.replace("N", ""), "".join(SYMBOLS[(ord(c) >> 1) & 3] for c in CHARACTERS if c != "N")), "[^ACTGN]", "N")


def base_code(symbol: Column) -> Column:
    return F.shiftright(F.ascii(symbol), 1).bitwiseAND(F.lit(3))


def code_base(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), code.bitwiseAND(F.lit(3)) + 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACTG", "TGAC"))


def digits(seq: Column) -> Column:
    """Symbols as base-4 digits; unknown is 4."""
    return F.translate(seq, "ACTGN", "01234")


def seed_code(seq: Column) -> Column:
    """The base-4 number of a seed's symbols, first symbol first; -1 if one is unknown."""
    d = digits(F.substring(seq, 1, SEED))
    return F.when(F.rlike(d, F.lit(f"^[0-3]{{{SEED}}}$")), F.conv(d, 4, 10).cast("int")).otherwise(F.lit(-1))


#: Symbols of a word of two bits each; bits that are set where two symbols differ.
WORD, LOW_BITS = 26, 0x5555555555555


def packed(seq: Column, at: int, n: int = WORD) -> Column:
    """`n` symbols (26 at most) from `at` as a long, two bits each, the first the highest; unknown and missing ones count as A."""
    known = F.rpad(F.translate(F.substring(seq, at, n), "ACTGN", "01230"), n, "0")
    return F.conv(known, 4, 10).cast("long")


def neighbour_words(seq: Column, at: int = SEED + 1, length: int = NEIGHBOUR) -> list[Column]:
    """The symbols from `at` on as words of 26."""
    return [packed(seq, at + k, min(WORD, length - k)) for k in range(0, length, WORD)]


def word_mismatches(a: list[Column], b: list[Column]) -> Column:
    """Positions where words of symbols differ."""
    out = None
    for x, y in zip(a, b, strict=True):
        differ = x.bitwiseXOR(y)
        n = F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(LOW_BITS)))
        out = n if out is None else out + n
    return out


def mismatches(a: Column, b: Column, length: int = NEIGHBOUR) -> Column:
    """Positions where two sequences of this length differ, N counting as A."""
    return word_mismatches(neighbour_words(a, 1, length), neighbour_words(b, 1, length))


def homopolymer(bases: Column, pos: Column, n: int = 12) -> Column:
    """Whether the `n` symbols before 0-based `pos` are all alike; false where they don't exist."""
    return F.when(pos >= n, F.rlike(F.substring(bases, pos - n + 1, F.lit(n)), F.lit(rf"^(.)\1{{{n - 1}}}$"))).otherwise(F.lit(False))


def percentage(depth: Column, cov: Column) -> Column:
    return F.when(cov == 0, F.lit(100).cast("long")).otherwise(F.floor(depth * 100 / cov)).cast("long")


def per(value: Column, total: Column) -> Column:
    """100 value / total, -1 of nothing."""
    return F.when(total == 0, F.lit(-1.0)).otherwise(100.0 * value / total)


def chromosome(name: Column) -> Column:
    """1..24 of 1, chr1, X, chrX, Y, chrY and so on; null for others."""
    bare = F.regexp_replace(name, "^chr", "")
    numbered = F.rlike(bare, F.lit("^(?:[1-9]|1[0-9]|2[0-4])$"))
    return F.when(bare == "X", F.lit(23)).when(bare == "Y", F.lit(24)).when(numbered, F.try_to_number(bare, F.lit("99")).cast("int"))


def variant_class(ref: Column, alt: Column) -> Column:
    """SUB, INS or DEL by allele lengths; null for others."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SUB").when((r > 1) & (a <= 1), "DEL").when((a > 1) & (r <= 1), "INS")


def dinucleotide_repeat(v: Column) -> Column:
    """Whether 12 symbols are one pair six times."""
    return F.repeat(F.substring(v, 1, 2), 6) == v


def elapsed(seconds: Column) -> Column:
    """Seconds as text in s, min or h."""
    return F.when(seconds < 60, F.format_string("%.2f s", seconds)).when(seconds < 3600, F.format_string("%.2f min", seconds / 60)).otherwise(F.format_string("%.2f h", seconds / 3600))


def register(spark) -> None:
    """SQL names of the encoders: seq_encode, revcomp, seed_code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACTG', 'TGAC'))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION seed_code(s STRING) RETURNS INT RETURN CASE WHEN substr(s, 1, {SEED}) RLIKE '^[ACTG]{{{SEED}}}$' THEN CAST(conv(translate(substr(s, 1, {SEED}), 'ACTG', '0123'), 4, 10) AS INT) ELSE -1 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seq_encode(s STRING) RETURNS STRING RETURN translate(upper(s), 'ACTGN', '01234')")
