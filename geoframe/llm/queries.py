"""The registered queries of the numbered operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from geoframe.llm import dac, decontam, hmm, html_extract, langid, merkle, mixing, packing, simhash, sketch, toxicity, url_filter, variants
from geoframe.llm.text import held_out
from geoframe.plans.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    dac.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return dac.read_documents(spark, path)


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 10, 0))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared_with_next(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    return langid.predict(docs, net).withColumn("held_out", held_out("doc_id", 4, 2))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    scored = toxicity.score(docs, model)
    return scored.withColumn("held_out", held_out("doc_id", 4, 2)).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


ALL = (op1_url_filter, op2_token_files, op3_hmm_scores, op4_decontamination, op5_html_text, op6_simhash, op7_packing, op8_scaled_sketch, op9_language_id, op10_toxicity, op11_mixing, op12_merkle_manifest, op13_spelling_variants)
QUERIES = {f.__name__: f for f in ALL}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.oracle(),
    "op11_mixing": mixing.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
    "op13_spelling_variants": variants.oracle(),
}
