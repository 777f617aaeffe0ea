"""A corpus pipeline over documents: language ID, near-duplicate join, secret scans, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three
return the columns of documents; the mix adds mix_place, which the packing follows; the last
returns the places of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import gga_pack, langid_svm, pfair_mix, secret_ledger, setjoin
from helixmill.llm._spark import documents, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; those without a letter, or without a language, go."""
    model = langid_svm.train(docs.where(~langid_svm.held_out()))
    return langid_svm.keep_known(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram join (five words, 0.8 or more), the document of the least id."""
    return setjoin.keep_one(docs, width=5, num=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    _, ledger, _ = secret_ledger.scan(docs)
    return secret_ledger.redact(docs, ledger, size="n_chars" if "n_chars" in docs.columns else None)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of their sources, with their places in it."""
    return pfair_mix.in_order(docs, numbered="mix_place")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens, which follow the mix."""
    return gga_pack.pack_documents(docs, order="mix_place")


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mix", mixed), ("pack", packed)]
#: SQL can't express the learned and the packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
