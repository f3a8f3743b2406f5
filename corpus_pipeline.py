"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next stage's docs.
All stages but the last return the columns of documents.  Rows of the mix come in
the order of its schedule.

Every stage works by row: null and empty texts, texts of any length, repeated
rows and ids, empty tables and further columns have the results that the stages'
modules state.  Python workers get texts in batches bounded by bytes.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markhive.llm import mixing, ngram_join, piece_codec, quality, toxicity
from markhive.llm.common import bounded_batches, documents, stored
from markhive.llm.queries import model_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the scorer learns from the labels that are not held out."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a quality rule rejects go."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by shingles of five words and a similarity of 0.8."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents come as often as their source's target takes them (0 to 2 times)."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the text that they decode to."""
    coded = piece_codec.there_and_back(docs.select("doc_id", "lang", "source", "text"), model_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


def _bounded(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _bounded(without_toxic)),
    ("quality_rules", _bounded(good_quality)),
    ("ngram_jaccard_join", _bounded(without_near_duplicates)),
    ("source_mixing", _bounded(mixed)),
    ("sentencepiece", _bounded(tokenized)),
]

#: SQL has no tokenizer, no model fitting and no graph components of this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
