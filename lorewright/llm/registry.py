"""The registered queries of the ten operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table as table
from . import exact_dedup, language, line_dedup, mixing, secrets, sentencepiece, simhash, topk, toxicity, url_filter


def labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels table where there is one."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetch_time", url_filter.fetch_time())
    return url_filter.evaluate(captures, url_filter.entries(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_source_mix, op3_sentencepiece, op4_line_dedup, op5_exact_topk, op6_secret_scan, op7_exact_dedup, op8_simhash_dedup, op9_url_filter, op10_language_id)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.oracle_sql(), "op4_line_dedup": line_dedup.oracle_sql(), "op5_exact_topk": topk.oracle_sql(), "op7_exact_dedup": exact_dedup.oracle_sql(), "op9_url_filter": url_filter.oracle_sql()}
