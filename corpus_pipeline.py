"""A corpus pipeline over `documents`: identify, filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; run() writes each stage's rows as Parquet and reads them again for
the next. Stages 1 to 4 return the columns of documents; the last adds the token ids.

1. language ID: drops documents without a determined language or a score under 0.4.
2. quality classifier: drops documents that score under 0.7, learned from `labels`.
3. n-gram Jaccard join: keeps the smallest id of each class of near duplicates.
4. benchmark decontamination: drops documents with an occurrence of a benchmark window.
5. SentencePiece encoding: adds ids, with begin and end, and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.llm import byte_cnn, gam, jaccard_join, merge_rounds, wu_manber
from burin.llm.common import persisted, scratch, table
from burin.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return byte_cnn.keep_known(docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return gam.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return wu_manber.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return merge_rounds.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The first two stages score with trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its rows are written
            docs = persisted(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
