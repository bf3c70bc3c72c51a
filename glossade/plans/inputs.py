"""What stands in for a tagged news corpus in the driver's tables.

Lines are documents split at line ends; language is documents.lang; the period is pre for sources 0 to 9 and post for the rest; a pair is
a user turn and the assistant turn after it; tags come from a rule; an embedding's language is its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_SPACE, words
from ..functions.tokens import count_key, key, rule_tokens, rule_upos
from ..operators import counts
from ..operators import lines as ln
from ..operators import prevalence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return ln.measured(ln.numbered(docs), ASCII_SPACE)


def period(source=None):
    return F.when(F.substring(F.col("source"), 4, 10).try_cast("int") < 10, "pre").otherwise("post")


def doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, key): a row a word."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.explode(rule_tokens(F.col("text"))).alias("t")).select("doc_id", "lang", "source", count_key(F.col("t")).alias("key"))


def key_counts(spark: SparkSession, sf_dir: str, **by) -> DataFrame:
    """(by..., key, count) of all words of documents; by: names and expressions."""
    docs = table(spark, sf_dir, "documents").select(*(c.alias(n) for n, c in by.items()), "text")
    return counts.count_words(docs, [*by], words(F.col("text"), ASCII_SPACE), lambda w: count_key(F.struct(w.alias("form"), F.lower(w).alias("lemma"), rule_upos(w).alias("upos"))))


def word_totals(spark: SparkSession, sf_dir: str, **by) -> DataFrame:
    """(by..., total): how many words documents have, as many as key_counts() counts, without making keys of them."""
    docs = table(spark, sf_dir, "documents").select(*(c.alias(n) for n, c in by.items()), word_count(F.col("text")).alias("n")).where("n > 0")
    return docs.groupBy(*by).agg(F.sum(F.col("n").cast("long")).alias("total"))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, key): a row a word of each line; a null key for a line without words."""
    own = lines(spark, sf_dir).select("doc_id", "line_no", F.explode_outer(rule_tokens(F.col("text"))).alias("t"))
    return own.select("doc_id", "line_no", F.when(F.col("t").isNotNull(), key(F.col("t"))).alias("key"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, model, h, m): tokens of a user turn and of the assistant's answer. model is conv_id modulo 3."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rule_tokens(F.col("text")).alias("w"))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("w").alias("h"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("m"))
    return user.join(answer, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "conv_id", F.pmod("conv_id", F.lit(3)).alias("model"), "h", "m")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked table of differences over all pairs, with log ratios."""
    return prevalence.ranked(prevalence.with_lpr(prevalence.wlas(pairs(spark, sf_dir))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def word_count(text) -> object:
    return F.size(words(text, ASCII_SPACE))
