"""Registered queries of this package: ``opN_<name>`` applies operator N with
production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.llm import (bpe, html_text, line_dedup, mixing, ngram_join, quality, secret_owners, sharding, suffix_dedup, token_alignment,
                         topk, toxicity, vector_codes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"), n=5, threshold=80)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_text=True, passage_words=51)
    return found.drop("spans").withColumnRenamed("kept_text", "text")


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_units(table(spark, sf_dir, "documents"), unit="line", min_words=1, passage_words=51)
    return found.drop("spans", "kept_text")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), power=0.5, seed=7)
    return mixed.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), shards=16)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), *vocabulary())


def op11_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_va_file": op1_va_file,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_array": op3_suffix_array,
    "op4_style_tree": op4_style_tree,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_stratified_shards": op9_stratified_shards,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secret_owners": op11_secret_owners,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op1_va_file": topk.ORACLE,
    "op7_poisson_mix": mixing.ORACLE,
    "op8_quality_cascade": quality.ORACLE,
    "op11_secret_owners": secret_owners.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
