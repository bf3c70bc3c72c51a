"""How alike two tables of key differences are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson, spearman
from .selection import top


def joined(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on key; columns get _1 and _2."""
    pick = lambda df, n: df.select("key", *(F.col(c).alias(f"{c}_{n}") for c in cols))
    return pick(a, 1).join(pick(b, 2), "key")


def lpr_pairs(a: DataFrame, b: DataFrame, guard: str = "both", least: float = 0.0, clip: float | None = None) -> DataFrame:
    """(key, x, y): log ratios of keys that pass the guard in both tables or either (the other's is null), and reach `least` in one."""
    met = joined(a, b, ["lpr_MH", "lpr_guard_ok"])
    one, two = F.col("lpr_guard_ok_1") == 1, F.col("lpr_guard_ok_2") == 1
    met = met.where(one & two if guard == "both" else one | two)
    clipped = lambda c: F.least(F.greatest(c, F.lit(-clip)), F.lit(clip)) if clip else c
    x, y = (clipped(F.when(ok, F.col(f"lpr_MH_{n}"))) for n, ok in ((1, one), (2, two)))
    return met.select("key", x.alias("x"), y.alias("y")).where(F.greatest(F.abs("x"), F.abs("y")) >= least)


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return top(pairs, k, [F.greatest(F.abs("x"), F.abs("y")).desc(), F.col("key")])


def correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), pearson(F.col("x"), F.col("y")).alias("pearson"))


def rank_correlation(pairs: DataFrame) -> DataFrame:
    return spearman(pairs, "x", "y")


def errors(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.agg(F.count("*").alias("n"), F.median(F.abs(d)).alias("median_abs_diff"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.count(d) / F.count("*")).alias("coverage"))


def relative_frequencies(a: DataFrame, b: DataFrame, side: str = "c_M", least: float = 10) -> DataFrame:
    """(key, x, y): counts over the totals of the common keys; then only keys with `least` in both tables together."""
    met = joined(a, b, [side])
    total = met.agg(F.sum(f"{side}_1").alias("t1"), F.sum(f"{side}_2").alias("t2"))
    met = met.crossJoin(F.broadcast(total))  # one row
    x, y = (F.try_divide(F.col(f"{side}_{n}"), F.nullif(f"t{n}", F.lit(0.0))) for n in (1, 2))
    return met.where(F.col(f"{side}_1") + F.col(f"{side}_2") >= least).select("key", x.alias("x"), y.alias("y"))


def find_column(columns: list[str], *names: str) -> str | None:
    """The column that has one of the names, whatever its case."""
    low = {c.lower(): c for c in columns}
    return next((low[n.lower()] for n in names if n.lower() in low), None)


def guarded(lpr: Column, count: Column, least: float) -> Column:
    return F.when(count >= least, lpr).otherwise(0.0)
