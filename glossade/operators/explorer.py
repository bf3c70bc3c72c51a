"""Rows and inventory of a word explorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import numbered


def model_name(name: Column) -> Column:
    """Without a leading las- and a trailing date."""
    return F.regexp_replace(F.regexp_replace(name, "^las-", ""), r"-\d{4}-\d{2}-\d{2}.*$", "")


def rows(table: DataFrame, k: int = 12, least: float = 20.0, compact: bool = False) -> DataFrame:
    """(w, u, las, lpr, a, h, r, rk_las, rk_lpr): occurrences per million of both sides, smoothed ratio, log2 ratio from `least` on, ranks before rounding."""
    own = table.where(F.col("key").rlike(r"[\p{L}\p{N}]"))
    if compact:
        own = own.where("c_M > 0")
    per = F.col("n_pairs") * k
    ratio = (F.col("c_M") + 1) / (F.col("c_H") + 1)
    lpr = F.when(F.col("c_M") >= least, F.log2(ratio)).otherwise(0.0)
    order = F.when(F.col("c_M") >= least, ratio).otherwise(1.0)
    own = numbered(numbered(own, "rk_las", F.col("LAS")), "rk_lpr", order)
    return own.select(
        F.regexp_extract("key", "^(.*)_[^_]*$", 1).alias("w"), F.regexp_extract("key", "_([^_]*)$", 1).alias("u"), F.round(F.col("LAS"), 6).alias("las"), F.round(lpr, 4).alias("lpr"),
        F.round(F.try_divide(F.col("c_M"), per) * 1e6, 1).alias("a"), F.round(F.try_divide(F.col("c_H"), per) * 1e6, 1).alias("h"), F.round(ratio, 4).alias("r"), "rk_las", "rk_lpr",
    )


def index(table: DataFrame, by: list[str]) -> DataFrame:
    """By group: n_words, n_over (LAS > 0), n_pairs."""
    return table.groupBy(*by).agg(F.count("*").alias("n_words"), F.count_if(F.col("LAS") > 0).alias("n_over"), F.max("n_pairs").alias("n_pairs"))


def document(rows_: DataFrame, meta: dict) -> DataFrame:
    """One row, json: {"meta": ..., "data": [...]} with the rows in order of rk_las. An explorer file holds one language's words, so its size is bounded by a vocabulary."""
    data = F.array_sort(F.collect_list(F.struct("rk_las", *(c for c in rows_.columns if c != "rk_las"))))
    return rows_.agg(F.to_json(F.struct(F.struct(*(F.lit(v).alias(k) for k, v in meta.items())).alias("meta"), data.alias("data"))).alias("json"))
