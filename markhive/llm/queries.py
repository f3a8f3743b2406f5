"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markhive.llm import hard_negatives, licenses, mixing, ngram_join, ngram_lm, order_minhash, piece_codec, quality, quality_net, token_counts, toxicity, url_filter, whitening
from markhive.llm.common import documents


def model_path() -> str:
    """The public SentencePiece vocabulary; found where the package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(documents(spark, sf_dir), model_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(documents(spark, sf_dir), model_path()))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir), width=3, percent=90)


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_edited(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(embeddings(spark, sf_dir))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.of_hundredths(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_quality_rules,
        op3_token_counts,
        op4_ngram_jaccard,
        op5_ngram_lm,
        op6_order_minhash,
        op7_license_scan,
        op8_url_filter,
        op9_toxicity,
        op10_source_mixing,
        op11_embedding_whitening,
        op12_quality_classifier,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {"op7_license_scan": licenses.oracle_sql(), "op8_url_filter": url_filter.ORACLE_SQL, "op13_hard_negatives": hard_negatives.oracle_sql()}
