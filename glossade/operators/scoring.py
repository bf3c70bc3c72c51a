"""Scores of sentences, documents and data sets by a table of key differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of differences of so many keys at most (some 40 MB) goes to every task, so that tokens are not dealt by key at all.
KEYS = 400_000
#: Beyond that so many tasks share the tokens of one key, however common it is; the table of differences is repeated as often.
SPREAD = 32


def deltas(table: DataFrame) -> DataFrame:
    """(key, delta): LAS where there is one, else the difference of the prevalences. Keys that repeat keep the last by rank."""
    d = F.coalesce("LAS", F.col("ell_M") - F.col("ell_H"))
    return table.groupBy("key").agg(F.max_by(d, F.col("rank_LAS")).alias("delta"))


def met(keys: DataFrame, delta: DataFrame, by: list[str]) -> DataFrame:
    """keys with the column delta, null where the table has none. A large table is dealt by key and a share of the lines, so that no task holds all tokens of a common key."""
    if delta.limit(KEYS + 1).count() <= KEYS:
        return keys.join(F.broadcast(delta), "key", "left")
    every = delta.withColumn("_share", F.explode(F.array(*(F.lit(i) for i in range(SPREAD)))))
    return keys.withColumn("_share", F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")).join(every, ["key", "_share"], "left").drop("_share")


def sentences(keys: DataFrame, delta: DataFrame, by: list[str], p: float | None = 2.0) -> DataFrame:
    """(by..., len_used, sLAS): keys has a row a token (by..., key; a null key counts as no token). p: the mean of |delta|**p to the 1/p; None: the signed mean."""
    own = met(keys, delta, by).withColumn("d", F.coalesce("delta", F.lit(0.0)))
    used = F.col("key").isNotNull()
    d = F.when(used, F.col("d"))
    score = F.avg(d) if p is None else F.pow(F.avg(F.pow(F.abs(d), F.lit(p))), F.lit(1 / p))
    return own.groupBy(*by).agg(F.count("key").alias("len_used"), F.coalesce(score, F.lit(0.0)).alias("sLAS"))


def documents(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("sLAS").alias("dLAS"), F.count("*").alias("n_sentences"))


def dataset(docs: DataFrame) -> DataFrame:
    return docs.agg(F.avg("dLAS").alias("mean_dLAS"), F.count("*").alias("n_docs"))
