"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burin.llm import byte_cnn, cover_tree, gam, jaccard_join, laesa, licenses, merge_rounds, orchard, page_diff, recurrent_lm, span_crf, token_transducer, wu_manber
from burin.llm.common import table
from burin.shipping import ship


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hits")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_rounds.encode_digests(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(table(spark, sf_dir, "embeddings"))


def op12_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.cluster(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_crf.report(table(spark, sf_dir, "documents"))


QUERIES = (op1_decontaminate, op2_quality_gam, op3_recurrent_lm, op4_exact_top_k, op5_main_text, op6_sentencepiece, op7_license_scan, op8_token_counts, op9_jaccard_join, op10_language_id, op11_vector_codes, op12_laesa_clusters, op13_personal_data)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": wu_manber.SQL, "op4_exact_top_k": cover_tree.SQL, "op7_license_scan": licenses.sql(), "op9_jaccard_join": jaccard_join.SQL, "op11_vector_codes": orchard.SQL, "op12_laesa_clusters": laesa.SQL}
