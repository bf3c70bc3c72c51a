"""Line- and block-wise scans of column files (ID FORM LEMMA UPOS, blocks between blank lines) in any store that Spark reads.

Lines and blocks are the text source's own records (a block ends at two line ends), so large files are split and no Python runs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_space
from ..functions.tokens import Tokenizer, fold_yo


def _named(df: DataFrame, *cols: Column) -> DataFrame:
    file = F.col("_metadata.file_path")  # cut without a pattern: it is told for every line
    folder = F.substring_index(F.substring_index(file, "/", -2), "/", 1)
    return df.select(folder.alias("lang"), F.regexp_extract(F.substring_index(file, "/", -1), r"(\d{4})[^/]*$", 1).try_cast("int").alias("year"), file.alias("file"), *cols)


def token_lines(spark: SparkSession, path: str, glob: str = "*.pos") -> DataFrame:
    """(lang, year, file, parts): every line that is neither blank nor a comment, cut at tabs; lang and year as in {lang}/{year}.pos."""
    own = _named(spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob), strip_space(F.col("value")).alias("line"))
    return own.where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select("lang", "year", "file", F.split("line", "\t", -1).alias("parts"))


def _key() -> Column:
    p = F.col("parts")
    return F.when(F.size(p) >= 4, F.concat(fold_yo(F.lower(p[2])), F.lit("_"), p[3]))


def keys(lines: DataFrame) -> DataFrame:
    """(lang, year, file, key) of token_lines() with four columns or more; shorter ones are skipped."""
    return lines.select("lang", "year", "file", _key().alias("key")).where("key is not null")


def targeted_counts(lines: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, year, key, count) of the keys in targets (lang, key), and (lang, year, total): the total counts malformed lines too."""
    counts = keys(lines).join(targets.select("lang", "key").distinct(), ["lang", "key"], "left_semi").groupBy("lang", "year", "key").agg(F.count("*").alias("count"))
    return counts, lines.groupBy("lang", "year").agg(F.count("*").alias("total"))


def blocks(spark: SparkSession, path: str, glob: str = "*.pos") -> DataFrame:
    """(lang, year, file, block): what stands between empty lines."""
    return _named(spark.read.option("lineSep", "\n\n").text(path, recursiveFileLookup=True, pathGlobFilter=glob), F.col("value").alias("block"))


def _within(own: DataFrame) -> DataFrame:
    """Blocks cut again where a line has nothing but white space."""
    return own.withColumn("block", F.explode(F.split("block", r"\n(?U:[\s\x1c-\x1f]*\n)+", -1)))


def sentence_lengths(spark: SparkSession, path: str, loose: bool = True, glob: str = "*.pos") -> DataFrame:
    """(lang, year, file, token_count) of sentences with a token.

    loose: lines of white space end a sentence, and any other line but a comment is a token. Strict: only empty lines end one, and a token has a tab.
    """
    own = _within(blocks(spark, path, glob)) if loose else blocks(spark, path, glob)
    blank = r"^(?U:[\s\x1c-\x1f]*)$"
    token = (lambda x: ~F.startswith(x, F.lit("#")) & ~x.rlike(blank)) if loose else (lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit("\t")))
    return own.select("lang", "year", "file", F.size(F.filter(F.split("block", "\n", -1), token)).alias("token_count")).where("token_count > 0")


def texts_with_counts(spark: SparkSession, path: str, glob: str = "*.pos") -> DataFrame:
    """(lang, year, file, text, token_count): a `# text =` line opens, the next one, `# sent_id` or a blank line closes; numbered rows count."""
    parts = F.split("block", r"\n(?=[ \t]*# (?:text =|sent_id))", -1)
    own = _within(blocks(spark, path, glob)).select("lang", "year", "file", F.explode(parts).alias("part"))
    own = own.select("lang", "year", "file", F.transform(F.split("part", "\n", -1), strip_space).alias("rows")).where(F.startswith(F.col("rows")[0], F.lit("# text =")))
    return own.select("lang", "year", "file", strip_space(F.substring(F.col("rows")[0], 9, (1 << 31) - 1)).alias("text"), F.size(F.filter("rows", lambda x: x.rlike(r"^\d+\t"))).alias("token_count")).where("token_count > 0")


def token_ratios(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """texts_with_counts() by language: files, sentences, and mean, deviation (0 of one), least and greatest of model tokens a parsed token."""

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        return pd.Series([*tokenizer(values.tolist())], dtype="int64")

    own = texts.withColumn("ratio", count("text") / F.col("token_count"))
    return own.groupBy("lang").agg(
        F.count_distinct("file").alias("files_analyzed"), F.count("*").alias("sentences_analyzed"), F.round(F.avg("ratio"), 4).alias("avg_bpe_per_pos_token"),
        F.round(F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)), 4).alias("std_dev"), F.round(F.min("ratio"), 4).alias("min_ratio"), F.round(F.max("ratio"), 4).alias("max_ratio"),
    )
