"""Mapping: oriented reads meet the seed index, candidates are scored, and the best of each read and chunk stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..functions.codec import MAX_SCORE, NEIGHBOUR, SEED, SUBSTITUTION, WORD, neighbour_words, reverse_complement, seed_code, word_mismatches
from ..sources import shared
from . import index, kernels, pairing, sweep


@pandas_udf(IntegerType())
def align_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Score of a read's neighbour against a reference neighbour."""
    for a, b in pairs:
        yield pd.Series(kernels.score(a.tolist(), b.tolist(), MAX_SCORE))


def orient(pairs: DataFrame, padded: int = 0) -> DataFrame:
    """num (4 pair_id + type), pair_id, type, seq: both mates and their reverse complements; symbols that pad a read's end pad that of its complement."""
    turned = lambda c: F.concat(reverse_complement(F.substring(F.col(c), F.lit(1), F.length(c) - padded)), F.lit("A" * padded)) if padded else reverse_complement(F.col(c))
    forms = F.array(F.col("seq1"), turned("seq1"), F.col("seq2"), turned("seq2"))
    four = pairs.select("pair_id", F.posexplode(forms).alias("type", "seq"))
    return four.select((4 * F.col("pair_id") + F.col("type")).alias("num"), "pair_id", "type", "seq")


READ_WORDS = [f"r{k}" for k in range(len(index.WORDS))]


def scorer(length: int = NEIGHBOUR):
    """align_score of the first `length` symbols of neighbours as words: those of the read, then those of the reference."""

    @pandas_udf(IntegerType())
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            words = np.stack([c.to_numpy() for c in columns], 1)
            half = words.shape[1] // 2
            out = kernels.score_codes(kernels.word_codes(words[:, :half])[:, :length], kernels.word_codes(words[:, half:])[:, :length], MAX_SCORE) if len(words) else np.zeros(0, np.int32)
            yield pd.Series(out.astype(np.int32))

    return score


word_score = scorer()


def compared(turn: int) -> int:
    """Symbols of a neighbour that round `turn` compares: whole bytes of four that no earlier round has cut off."""
    return NEIGHBOUR - 4 * (SEED * turn // 4)


def probes(reads: DataFrame, key: str = "num") -> DataFrame:
    """key, seed and the words of the neighbour of each read; reads whose seed has an unknown symbol find nothing."""
    words = [w.alias(r) for r, w in zip(READ_WORDS, neighbour_words(F.col("seq")), strict=True)]
    return reads.select(key, seed_code(F.col("seq")).alias("seed"), *words).where("seed >= 0")


def met(probe: DataFrame, target: DataFrame | index.Index, key: str = "num", passing: list[DataFrame] | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The seed join with a genome or with an index, and what gives its rows (or some of them) their chunk_id.

    Of a genome only the positions of seeds that some read has are taken; those of a common seed meet a read in as many
    parts, by sequence and block, as it has chunks, and chunks are for the rows that are left in the end. `passing` is
    given the tables that may go when the rows were used.
    """
    if isinstance(target, index.Index):
        asked = probe.join(target.common, "seed", "left").withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
        return asked.join(target.rows, ["seed", "chunk_id"]).select(key, "seed", "seq_nr", "seed_nr", "chunk_id", *READ_WORDS, *index.WORDS), lambda found: found
    here = index.used(target, probe)
    if passing is not None:
        passing += [here.rows, here.common]
    lasts = here.common.select("seed", "last")
    asked = probe.join(lasts, "seed", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
    part = F.coalesce(F.pmod(F.hash("seq_nr", index.block_of()), F.col("last") + 1), F.lit(0))
    rows = here.rows.join(lasts, "seed", "left").withColumn("_part", part).drop("last")
    found = asked.join(rows, ["seed", "_part"]).select(key, "seed", "seq_nr", "seed_nr", "nth", *READ_WORDS, *index.WORDS)
    return found, lambda some: index.located(some, here.common, here.before)


def candidates(probe: DataFrame, target: DataFrame | index.Index, key: str = "num") -> DataFrame:
    """key, seq_nr, seed_nr, chunk_id and the words of read and reference: the seed join, with a genome or with an index."""
    found, placed = met(probe, target, key)
    return placed(found).select(key, "seq_nr", "seed_nr", "chunk_id", *READ_WORDS, *index.WORDS)


def hits(probe: DataFrame, target: DataFrame | index.Index, gaps: bool = True, turn: int = 0, key: str = "num", passing: list[DataFrame] | None = None) -> DataFrame:
    """key, seq_nr, seed_nr, chunk_id, score: the candidates whose score is low enough; only they get a chunk."""
    found, placed = met(probe, target, key, passing)
    return placed(scored(found, gaps, turn)).select(key, "seq_nr", "seed_nr", "chunk_id", "score")


def scored(found: DataFrame, gaps: bool = True, turn: int = 0) -> DataFrame:
    """Candidates with a score of 40 at most, of substitutions alone or with gaps, in the symbols that a round compares."""
    n = compared(turn)
    own, other = [F.col(c) for c in READ_WORDS], [F.col(c) for c in index.WORDS]
    if gaps:
        score = (scorer(n) if turn else word_score)(*own, *other)
    else:
        keep = [((1 << 2 * WORD) - 1) & ~((1 << 2 * max(0, min(WORD, WORD * (k + 1) - n))) - 1) for k in range(len(own))]  # the first n symbols, in the high bits
        score = (SUBSTITUTION * word_mismatches(*[[c.bitwiseAND(F.lit(m)) for c, m in zip(side, keep, strict=True)] for side in (own, other)])).cast("int")
    return found.withColumn("score", score).where(F.col("score") <= MAX_SCORE).drop(*READ_WORDS, *index.WORDS)


def best(hits: DataFrame, key: str = "num") -> DataFrame:
    """The hits of least score of each read and index chunk, ties included."""
    return hits.withColumn("_r", F.rank().over(Window.partitionBy(key, "chunk_id").orderBy("score"))).where("_r = 1").drop("_r")


def map_reads(pairs: DataFrame, target: DataFrame | index.Index, gaps: bool = True, turn: int = 0, seen: Observation | None = None) -> DataFrame:
    """num, seq_nr, seed_nr, chunk_id, score: best hits of all orientations of all pairs, in a genome (sequences or blocks) or by an index, stored or not. They are written once, since pairing reads them several times; `seen` observes their number as they are."""
    probe = probes(orient(pairs, SEED * turn))
    blocks = None if isinstance(target, index.Index) else sweep.ordered(target)
    found = best(hits(probe, target, gaps, turn)) if blocks is None else sweep.hits(blocks, probe, READ_WORDS, gaps, compared(turn), "num")
    out = shared.kept(found.observe(seen, F.count(F.lit(1)).alias("hits")) if seen else found)
    if blocks is not None:
        blocks.unpersist()
    return out


def each_hit(pairs: DataFrame, genome: DataFrame, gaps: bool = True) -> DataFrame:
    """The rows of map_reads in a genome, made as they are read and not kept."""
    return sweep.hits(sweep.ordered(genome), probes(orient(pairs)), READ_WORDS, gaps, key="num")


def each_score(pairs: DataFrame, genome: DataFrame) -> DataFrame:
    """num, seq_nr, seed_nr, score of all candidates, with gaps."""
    return sweep.candidates(sweep.ordered(genome), probes(orient(pairs)), READ_WORDS)


def distinct_hits(pairs: DataFrame, genome: DataFrame, gaps: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best hits (rid, seq_nr, seed_nr, score) of distinct reads, and which read each is (num, rid), as tables: what `pairing` takes for reads that are alike. With `exact`, as `sweep.exact`."""
    probe = probes(orient(pairs))
    blocks = sweep.ordered(genome)
    found = sweep.exact(blocks, probe, READ_WORDS, gaps).distinct() if exact else sweep.hits(blocks, probe, READ_WORDS, gaps).drop("chunk_id")
    out = shared.kept(found), shared.kept(sweep.members(probe, READ_WORDS))
    blocks.unpersist()
    return out


def exact_hits(pairs: DataFrame, target: DataFrame | index.Index, gaps: bool = True) -> DataFrame:
    """num, seq_nr, seed_nr, score of the hits of score 0, each once; and of each pair with any hit a row of its own without a place and score: all that `pairing.unmapped` takes of `map_reads`.

    A hit of score 0 is a best one in any chunk, and a read with hits has a best one, so that hits are neither ranked nor given chunks, and tasks add up what they find.
    """
    passing: list[DataFrame] = []
    found, _ = met(probes(orient(pairs)), target, passing=passing)
    some, whole = scored(found, gaps), F.col("score") == 0
    rows = some.select(F.when(whole, F.col("num")).otherwise(4 * F.expr("num div 4")).alias("num"), *[F.when(whole, F.col(c)).alias(c) for c in ("seq_nr", "seed_nr", "score")])
    out = shared.kept(rows.distinct())
    shared.dropped(*passing)
    return out


def rounds(pairs: DataFrame, target: DataFrame | index.Index, n: int = 2, gaps: bool = True) -> DataFrame:
    """The best hits of up to `n` rounds, with their round: pairs that have hits but no valid pair move on by a seed, so that an error in a read's seed costs a round and not the read.

    Each round's pairs and hits are tables, so that no round computes those before again.
    """
    out = None
    for turn in range(n):
        mapped = map_reads(pairs, target, gaps, turn)
        marked = mapped.withColumn("round", F.lit(turn))
        out = marked if out is None else out.unionByName(marked)
        if turn + 1 < n:
            left = pairing.unmapped_fasta(pairs, pairing.unmapped(mapped, pairing.paired(mapped)), turn)
            pairs = shared.kept(left.groupBy("pair_id").agg(*[F.max(F.when(F.col("mate") == i, F.col("seq"))).alias(f"seq{i}") for i in (1, 2)]))
    return out


def register(spark) -> None:
    spark.udf.register("align_score", align_score)
