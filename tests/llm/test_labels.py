"""Toxicity and language ID: held-out accuracy, exact counts, and every edge."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.llm import _bytes, langid_svm, queries, toxicity_kn


def test_word_digests_match_words():
    texts = ["Hello wörld hello", "", "a  b\tc", "x" * 5000 + " hello", None, "hello"]
    data, off = _bytes.buffer(pa.array(texts))
    h, first, _ = _bytes.words(data, off, _bytes.WHITE_WORDS)
    words = [(t or "").lower().split() for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    seen = {}
    for d, w in zip(h.tolist(), sum(words, []), strict=True):
        assert seen.setdefault(w, d) == d
    assert len(set(seen.values())) == len(seen)


def test_words_in_pieces(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    data, off = _bytes.buffer(pa.array([text, "tail words", "y" * 400]))
    whole = _bytes.words(data, off, _bytes.WHITE_WORDS)
    monkeypatch.setattr(_bytes, "PIECE", 97)
    parts = _bytes.words(data, off, _bytes.WHITE_WORDS)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


KN = [(0, "the cat the hat and the catalogue"), (1, "you moronic the cat"), (0, ""), (1, "the moron moron and you"), (0, "the cat the hat"), (0, "and you wonderful wonderfully catalogues")]


def plain_ratio(rows, word):
    """The log ratio of a word by the formulas, from sets of (word before, word)."""
    pairs = [{p for t, x in rows if t == c for w in [x.split()] for p in zip(["", *w], w)} for c in (0, 1)]
    pairs.append(pairs[0] | pairs[1])
    cuts, ratio = [0, 4, 6, 8, 99], 0.0
    for low, high in zip(cuts, cuts[1:]):
        n = [sum(w[:high] == word[:high] for _, w in p) for p in pairs]
        of = [sum(w[:low] == word[:low] for _, w in p) for p in pairs]
        m = [len({w[:high] for _, w in p if w[:low] == word[:low]}) for p in pairs]
        shared = (n[2] + 0.5) / (of[2] + (m[2] + 1) / 2)
        step = [(max(n[c] - 0.75, 0) + (0.75 * m[c] + 1) * shared) / (of[c] + 1) for c in (0, 1)]
        ratio += math.log(step[1] / step[0])
    return ratio


def test_a_task_holds_few_pairs(monkeypatch):
    """One batch of many runs is handed on in parts, with the same counts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(chr(97 + x // 26) + chr(97 + x % 26) for x in rng.integers(0, 500, 40)) for _ in range(200)]
    toxic = [r % 3 == 0 for r in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array([int(t) for t in toxic], pa.int32()), pa.array(texts)], ["toxic", "text"])

    def counted():
        parts = list(toxicity_kn._pairs(iter([batch])))
        total = Counter()
        for part in parts:
            for w, v, a, b in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                total[w, v, 0] += a
                total[w, v, 1] += b
        return max(part.num_rows for part in parts), total

    _, whole = counted()
    monkeypatch.setattr(toxicity_kn, "HELD", 400)
    monkeypatch.setattr(_bytes.runs, "__defaults__", (1000,))
    most, parts = counted()
    assert most < 800 and parts == whole
    assert sum(whole.values()) == 40 * len(texts)


def test_ratios_by_the_formulas(spark):
    c, pairs = toxicity_kn.count(spark.createDataFrame(KN, "toxic int, text string").repartition(3))
    seen = sorted({w for _, x in KN for w in x.split()} | {"unknown", "morons", "wonders"})
    levels, v, first = toxicity_kn.words(*_bytes.buffer(pa.array([" ".join(seen)])))
    assert toxicity_kn.ratios(c, levels) == pytest.approx([plain_ratio(KN, w) for w in seen])
    for own, (toxic, text) in enumerate(KN):  # a text's own counts taken out
        levels, v, first = toxicity_kn.words(*_bytes.buffer(pa.array([text])))
        rest = KN[:own] + KN[own + 1 :]
        got = toxicity_kn.ratios(c, levels, (toxic, toxicity_kn._lost(pairs, toxic, v, levels[-1])))
        assert got == pytest.approx([plain_ratio(rest, w) for w in text.split()])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = Counter((r.toxic, rows[r.doc_id].predicted) for r in labels if rows[r.doc_id].held_out)
    assert got[1, 1] >= 2 * got[1, 0] and got[0, 0] >= 20 * got[0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"plain words here {i} good") for i in range(40)] + [(100 + i, f"you moron scum {i}") for i in range(40)] + [(None, "x"), (7, None), (7, ""), (8, "12 34")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity_kn.learn(docs, labels)
    new = spark.createDataFrame([(1, "such a moron", 9.0), (2, "good plain words", 9.0), (None, None, 9.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity_kn.score(new, model).collect()}
    assert got[1] > 0.3 > got[2] and got[None] == pytest.approx(model.prior)
    none = toxicity_kn.learn(docs.limit(0), labels)
    assert toxicity_kn.score(new, none).count() == 3
    assert toxicity_kn.score(new.limit(0), model).count() == 0


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in docs if rows[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(rows) == len(docs)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    docs = spark.createDataFrame([(i, "the house and the garden " * 3, "en", "?") for i in range(30)] + [(50 + i, "das haus und der garten " * 3, "de", "?") for i in range(30)] + [(None, "x", None, None)], schema)
    model = langid_svm.train(docs)
    odd = spark.createDataFrame([(1, None, None, "?"), (2, "", "en", None), (3, "12 34 !", "en", None), (4, "the garden", None, None), (4, "der garten", None, None)], schema)
    got = [(r.doc_id, r.lang_pred) for r in langid_svm.predict(odd, model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en")]
    assert langid_svm.keep_known(odd, model).columns == odd.columns and langid_svm.keep_known(odd, model).count() == 2
    nothing = langid_svm.train(docs.limit(0))
    assert {r.lang_pred for r in langid_svm.predict(odd, nothing).collect()} == {"und"}
    alone = langid_svm.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid_svm.predict(docs.limit(5), alone).collect()} == {"en"}
    assert langid_svm.predict(odd.limit(0), model).count() == 0


def test_unlearned_languages_and_junk_are_not_known(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid_svm.train(docs.where(~langid_svm.held_out() & (F.col("lang") != "es")))
    held = docs.where(langid_svm.held_out())
    clean, unlearned = held.where("lang != 'es'"), held.where("lang = 'es'")
    assert langid_svm.keep_known(clean, model).count() >= 0.97 * clean.count()
    assert langid_svm.keep_known(unlearned, model).count() <= 0.1 * unlearned.count()
    junk = ["x", "0 1 2 3 a 4 5 6 7", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ" * 4, "zxqj wvkp qqqq", "\u4e2d\u6587\u6587\u672c"]
    assert langid_svm.keep_known(spark.createDataFrame([(i, t, None) for i, t in enumerate(junk)], docs.schema), model).count() == 0
