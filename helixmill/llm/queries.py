"""The registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25_wand, brown_lm, feistel_shards, gga_pack, iblt_fingerprint, langid_svm, pfair_mix, pii_disclosure, prefix_trie, secret_ledger, setjoin, toxicity_kn, vp_negatives
from ._spark import documents


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid_svm.train(docs.where(~langid_svm.held_out()))
    seen = langid_svm.predict(docs.select("doc_id", "text"), model)
    return seen.select("doc_id", langid_svm.held_out().alias("held_out"), "lang_pred", "score")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, ledger, _ = secret_ledger.scan(documents(spark, sf_dir))
    return secret_ledger.findings(paths, ledger).withColumnRenamed("path", "doc_id")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bm25_wand.search(docs, docs.where("doc_id % 20 = 0"))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return pfair_mix.mix(docs)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.digest(pii_disclosure.find(documents(spark, sf_dir)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gga_pack.pack_documents(documents(spark, sf_dir))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.materialise_documents(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt_fingerprint.versions(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learning = ~toxicity_kn.held_out()
    model = toxicity_kn.learn(docs.where(learning), labels.where(learning))
    scored = toxicity_kn.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity_kn.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = vp_negatives.mine(vectors, F.col("id") % 50 == 0, label=label)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


def op12_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", brown_lm.held_out().alias("held_out"))
    model = brown_lm.learn(docs.where("NOT held_out"))
    seen = brown_lm.score(docs, model, ["doc_id", "held_out"])
    return seen.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.digest(nodes)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_topk_search": op2_topk_search,
    "op3_weighted_mix": op3_weighted_mix,
    "op4_ngram_join": op4_ngram_join,
    "op5_personal_data": op5_personal_data,
    "op6_training_order": op6_training_order,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_brown_lm": op12_brown_lm,
    "op13_prefix_trie": op13_prefix_trie,
}
