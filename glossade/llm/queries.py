"""The thin queries over the driver's tables, one an operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, decontaminate, language, repeats, simhash, toxicity, urls
from .media import media_columns
from .packing import pack
from .token_counts import count_tokens


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), with_ids=False)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language.identify(docs, language.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_rules": urls.judge_sql(), "op5_archives": archives.SQL}
