"""Language identification: first the family, then linear SVMs among the languages of that family.

Features are hashed byte n-grams of the lower-cased text, as shares of its n-grams. One-versus-one
SVMs decide between families, and between the languages of the family that won. All weights are
linear in the shares, so that a text of any length is scored by one pass of gathers.

The SVMs only tell languages from one another. Whether a text is of the chosen language at all is
told by its mean log-likelihood ratio of trigrams, those of the language against any alike. A
language's bound is set on labelled texts that its trigrams weren't counted on: between those of
other languages and its own. The score is the lesser of the SVMs' and the likelihood's confidence,
and under 0.5 for texts below the bound.

Edge cases: a text that is null, empty or without a letter is `und` with score 0; rows with a null
language or null id teach nothing (a null id counts as not held out); with one known language all
other texts get it, with the score of their likelihood; with none at all they get `und`. A text
without a trigram has the least likelihood. Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes

#: Language families by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ur",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
ORDERS = (2, 3)
BITS = 16
UNKNOWN = "und"
#: The n-grams of the likelihoods, and the weight of the alike ones in them.
PROFILED, ALIKE = 3, 0.05


@dataclass(frozen=True)
class LanguageModel:
    """weights: a row for each one-versus-one model, then one for each language's likelihood; pairs: the two classes that each model tells apart; bound, scale: of the likelihoods."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    family_pairs: tuple[tuple[int, int], ...]
    language_pairs: tuple[tuple[int, int, int], ...]
    weights: np.ndarray
    bias: np.ndarray
    bound: np.ndarray
    scale: np.ndarray

    @property
    def duels(self) -> int:
        return len(self.family_pairs) + len(self.language_pairs)


def _grams(b: np.ndarray, n: int) -> np.ndarray:
    """Feature of the n-gram at each byte."""
    x = b[: len(b) - n + 1].astype(np.uint32)
    for j in range(1, n):
        x = x * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j]
    x *= np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - BITS)).astype(np.int32)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _bytes.buffer(pc.utf8_lower(column))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, features, shares) of each text."""
    for batch in batches:
        langs, feature, share = [], [], []
        for r in range(batch.num_rows):
            b, _ = _lowered(batch.column(1).slice(r, 1))
            found, values = [], []
            for k, n in enumerate(ORDERS):
                if len(b) >= n:
                    f, count = np.unique(_grams(b, n), return_counts=True)
                    found.append(f + (k << BITS))
                    values.append(count / (len(b) - n + 1))
            if found:
                langs.append(batch.column(0)[r].as_py())
                feature.append(np.concatenate(found).astype(np.int32).tobytes())
                share.append(np.concatenate(values).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(feature, pa.binary()), pa.array(share, pa.binary())], ["lang", "feature", "share"])


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, epochs: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged stochastic subgradients (step 1 / (penalty * t)); either class weighs the same."""
    w, total, scale, bias = np.zeros(len(ORDERS) << BITS), np.zeros(len(ORDERS) << BITS), 1.0, 0.0
    side = {s: np.flatnonzero(sign == s) for s in (-1.0, 1.0)}
    rng, steps = np.random.default_rng(seed), epochs * len(rows)
    biases = 0.0
    for t in range(1, steps + 1):
        s = 1.0 if t % 2 else -1.0
        f, v = rows[rng.choice(side[s])]
        rate = 1 / (penalty * (t + 1 / penalty))
        margin = s * (scale * (w[f] @ v) + bias)
        scale *= 1 - rate * penalty
        if margin < 1:
            w[f] += rate * s / scale * v
            bias += 0.01 * rate * s
        if t > steps // 2 and t % 16 == 0:
            total += scale * w
            biases += bias
    n = max(1, sum(1 for t in range(steps // 2 + 1, steps + 1) if t % 16 == 0))
    return total / n, biases / n


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 300, epochs: int = 8, penalty: float = 1e-4, seed: int = 7) -> LanguageModel:
    """Fit from a sample of about `per_language` labelled texts for each language (a documented bound); the sample is of whole texts, chosen by a hash of the id."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel((), (), (), (), np.zeros((0, len(ORDERS) << BITS)), np.zeros(0), np.zeros(0), np.zeros(0))
    keep = F.lit(0)
    for code, n in sorted(sizes.items()):
        keep = F.when(F.col(lang) == code, F.lit(int(min(1.0, per_language / n) * (1 << 31)))).otherwise(keep)
    chosen = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < keep)
    rows = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_histograms, "lang string, feature binary, share binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    codes = np.array([r[0] for r in rows])
    data = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32).astype(float) * 30) for r in rows]
    learned = sorted(set(codes.tolist()))
    families = tuple(sorted({FAMILY_OF.get(c, c) for c in learned}))
    languages = tuple(tuple(c for c in learned if FAMILY_OF.get(c, c) == f) for f in families)
    family = np.array([families.index(FAMILY_OF.get(c, c)) for c in codes.tolist()])
    family_pairs = tuple((a, b) for a in range(len(families)) for b in range(a + 1, len(families)))
    language_pairs = tuple((f, a, b) for f, of in enumerate(languages) for a in range(len(of)) for b in range(a + 1, len(of)))
    fits = []
    tasks = [(family == a, family == b) for a, b in family_pairs] + [(codes == languages[f][a], codes == languages[f][b]) for f, a, b in language_pairs]
    for yes, no in tasks:
        pick = np.flatnonzero(yes | no)
        fits.append(_svm([data[i] for i in pick], np.where(yes[pick], 1.0, -1.0), epochs, penalty, seed))
    profiles, bound, scale = _likelihoods(data, codes, [c for of in languages for c in of])
    weights = np.concatenate([np.array([w * 30 for w, _ in fits]).reshape(len(fits), len(ORDERS) << BITS), profiles])
    return LanguageModel(families, languages, family_pairs, language_pairs, weights, np.array([b for _, b in fits] + [0.0] * len(profiles)), bound, scale)


def _likelihoods(data: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each language's log ratios as weights, the bound of its likelihood and the scale of the confidence around it; texts are scored by counts of the other half."""
    base, turn = ORDERS.index(PROFILED) << BITS, {c: 0 for c in names}
    half = np.zeros(len(data), int)
    for i, c in enumerate(codes.tolist()):
        half[i] = turn[c] % 2
        turn[c] += 1

    def profile(at: np.ndarray) -> np.ndarray:
        mean = np.zeros(1 << BITS)
        for i in at:
            f, v = data[i]
            mean[f[f >= base] - base] += v[f >= base] / 30
        return np.log((1 - ALIKE) * mean / max(mean.sum(), 1e-9) * (1 << BITS) + ALIKE)

    def likelihood(log: np.ndarray, i: int) -> float:
        f, v = data[i]
        return float(log[f[f >= base] - base] @ v[f >= base] / 30) if (f >= base).any() else np.log(ALIKE)

    profiles, bound, scale = np.zeros((len(names), len(ORDERS) << BITS)), np.zeros(len(names)), np.ones(len(names))
    for k, c in enumerate(names):
        own = np.flatnonzero(codes == c)
        profiles[k, base : base + (1 << BITS)] = profile(own)
        of_half = [profile(own[half[own] != h] if len(own) > 1 else own) for h in (0, 1)]
        seen = np.array([likelihood(of_half[half[i]], i) for i in range(len(data))])
        others = seen[codes != c]
        low, high = np.quantile(others, 0.99) if len(others) else np.log(ALIKE), np.quantile(seen[own], 0.005)
        bound[k], scale[k] = min(low + (high - low) / 3, high), max(abs(high - low), 0.1) / 6
    return profiles, bound, scale


def margins(model: LanguageModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row's margin in each of the one-versus-one models, then its likelihood in each language."""
    out = np.tile(model.bias, (len(off) - 1, 1))
    for lo, hi in _bytes.runs(off):
        for a in range(lo, hi) if hi - lo == 1 else (lo,):
            b = a + 1 if hi - lo == 1 else hi
            for k, n in enumerate(ORDERS):
                rows = slice(None) if n == PROFILED else slice(0, model.duels)
                _add(out[a:b, rows], model.weights[rows, k << BITS : (k + 1) << BITS], data, off[a : b + 1], n)
    out[np.diff(off) < PROFILED, model.duels :] = np.log(ALIKE)
    return out


def _add(out: np.ndarray, weights: np.ndarray, data: np.ndarray, off: np.ndarray, n: int) -> None:
    count = np.maximum(np.diff(off) - n + 1, 0)
    total = np.zeros((len(weights), len(count)))
    begin, end = int(off[0]), int(off[-1])
    for p in range(begin, max(begin, end - n + 1), _bytes.PIECE):  # one piece, but for a long text
        q = min(p + _bytes.PIECE, end - n + 1)
        g = _grams(data[p : q + n - 1], n)
        lo, hi = np.clip(off[:-1] - p, 0, q - p), np.clip(off[:-1] + count - p, 0, q - p)
        for m, w in enumerate(weights):
            sums = np.zeros(len(g) + 1)
            np.cumsum(w[g], out=sums[1:])
            total[m] += sums[hi] - sums[lo]
    out += (total / np.maximum(count, 1)).T


def decide(model: LanguageModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row and a confidence: that of the less certain of the two choices, or of the language's likelihood if less."""
    n, names = len(margin), np.array([c for of in model.languages for c in of])
    if not len(names):
        return np.full(n, UNKNOWN), np.zeros(n)
    family, sure = _vote(margin[:, : len(model.family_pairs)], [(a, b) for a, b in model.family_pairs], len(model.families))
    first = np.cumsum([0, *map(len, model.languages)])
    pick = first[family]
    at = len(model.family_pairs)
    for f, of in enumerate(model.languages):
        pairs = [(a, b) for g, a, b in model.language_pairs if g == f]
        here = family == f
        if pairs:
            won, by = _vote(margin[here, at : at + len(pairs)], pairs, len(of))
            pick[here] += won
            sure[here] = np.minimum(sure[here], by)
        at += len(pairs)
    inside = (margin[np.arange(n), model.duels + pick] - model.bound[pick]) / model.scale[pick]
    return names[pick], 1 / (1 + np.exp(-np.clip(np.minimum(sure, inside), -50, 50)))


def _vote(margin: np.ndarray, pairs: list[tuple[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class with the most duels won (ties: the larger sum of margins), and its least margin in a duel."""
    n = len(margin)
    if not pairs:
        return np.zeros(n, int), np.full(n, 50.0)
    wins, sums, least = np.zeros((n, classes)), np.zeros((n, classes)), np.full((n, classes), np.inf)
    for k, (a, b) in enumerate(pairs):
        for c, m in ((a, margin[:, k]), (b, -margin[:, k])):
            wins[:, c] += m > 0
            sums[:, c] += m
            least[:, c] = np.minimum(least[:, c], m)
    best = np.argmax(wins + sums / (1 + np.abs(sums).sum(1, keepdims=True)), 1)
    return best, least[np.arange(n), best]


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score (both names after `prefix`), which replace columns of those names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = (f"{prefix}lang_pred", f"{prefix}score")
    kept = [c for c in docs.columns if c not in out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out[0], "string").add(out[1], "double")
    position = kept.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(position), "")
            data, off = _lowered(column)
            names, sure = decide(shared.value, margins(shared.value, data, off))
            letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            names, sure = np.where(letters, names, UNKNOWN), np.where(letters & (names != UNKNOWN), sure, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*kept, *out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fold_of(doc_id: object, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a confidence of `least` or more; the columns of docs."""
    seen = predict(docs, model, text, "_seen_")
    return seen.where((F.col("_seen_lang_pred") != UNKNOWN) & (F.col("_seen_score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
