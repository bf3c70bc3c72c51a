"""Line filters and length profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE_SPACE, words

BOUNDARIES = (10, 20, 30, 40, 50, 60, 80, 100, 150, 200, 300)


def numbered(docs: DataFrame) -> DataFrame:
    """A row a line of text, numbered from 1; the other columns stay. A null text has no lines."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def measured(lines: DataFrame, space: str = UNICODE_SPACE) -> DataFrame:
    """Adds n_chars (code points), n_tokens, and keep: within both limits of long_lines()."""
    return lines.withColumns({"char_len": F.length("text"), "token_count": F.size(words(F.col("text"), space))})


def kept(lines: DataFrame, tokens: int = 200, chars: int = 1500) -> DataFrame:
    return lines.withColumn("keep", (F.col("token_count") <= tokens) & (F.col("char_len") <= chars))


def log_form(lines: DataFrame) -> DataFrame:
    """Dropped lines as they are logged: tabs written out."""
    return lines.where(~F.col("keep")).withColumn("line_content", F.replace("text", F.lit("\t"), F.lit("\\t"))).drop("text", "keep")


def length_distribution(sentences: DataFrame, by: list[str], boundaries=BOUNDARIES) -> DataFrame:
    """total and, for each boundary, the percentage of sentences with more tokens."""
    total = F.count("*")
    return sentences.groupBy(*by).agg(total.alias("total"), *((F.count_if(F.col("token_count") > b) * F.lit(100.0) / total).alias(f"gt_{b}") for b in boundaries))


def average_length(sentences: DataFrame, by: list[str]) -> DataFrame:
    return sentences.groupBy(*by).agg(F.count("*").alias("total_sentences"), F.sum("token_count").alias("total_tokens"), F.avg("token_count").alias("avg_tokens"))


def window_profile(sentences: DataFrame, by: str, boundary: int = 24) -> DataFrame:
    """Long and short lines by group and over all (a null group): counts, share, and the median length of long lines."""
    long_ = F.col("token_count") >= boundary
    return sentences.rollup(by).agg(F.count("*").alias("n_lines"), F.count_if(long_).alias("n_long"), (F.count_if(long_) / F.count("*")).alias("long_share"), F.median(F.when(long_, F.col("char_len"))).alias("median_long_chars"))
