"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: p < 0.001 with one degree of freedom.
CHI2_001 = 10.827566170662733


def jeffreys(count: Column, n: Column) -> Column:
    return (count + 0.5) / (n + F.lit(1.0))


def yates_chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected chi-square of [[a, b], [c, d]]; null where an expected count is 0."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


def chi2_p(chi2: Column) -> Column:
    """p of a chi-square with one degree of freedom: erfc(sqrt(x / 2)), by a continued fraction in the tail and a series near 0; 1 for null."""
    z = F.sqrt(F.coalesce(chi2, F.lit(0.0)) / 2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda s, n: F.struct((s["term"] * (-z * z / n)).alias("term"), (s["total"] + s["term"] * (-z * z / n) / (2 * n + 1)).alias("total")),
    )
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: (k / 2.0) / (z + t))
    return F.when(z < 2, F.lit(1.0) - series["total"] * 1.1283791670955126).otherwise(F.exp(-z * z) * 0.5641895835477563 / (z + tail))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; null under two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def numbered(df: DataFrame, name: str, value: Column, key: str = "key") -> DataFrame:
    """df with its rows' places from 1, by value from the largest, ties by key.

    Rows are counted by value and the key's first characters, and places summed over these counts, of which there are far fewer; only rows that
    share both are put in order together.
    """
    v, p, n, before = (f"_{name}_{c}" for c in ("v", "p", "n", "before"))
    own = df.withColumns({v: value, p: F.substring(key, 1, 2)})
    w = Window.orderBy(F.desc(v), p).rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(v, p).agg(F.count("*").alias(n)).select(v, p, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(v, p).orderBy(key))
    return own.join(counts, [v, p]).withColumn(name, (place + F.col(before)).cast("int")).drop(v, p, before)


def with_average_rank(df: DataFrame, name: str, x: str, *by: str) -> DataFrame:
    """df with ranks from 1, ties at their mean, within the groups named. Values are counted first and ranks summed over the counts. x must not be null."""
    v, n, of = f"_{name}_v", f"_{name}_n", {c: f"_{name}_{c}" for c in by}
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*of.values()).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(*(F.col(c).alias(k) for c, k in of.items()), F.col(x).alias(v)).agg(F.count("*").alias(n))
    ranks = counts.select(*of.values(), v, (before + (F.col(n) + 1) / 2).alias(name))
    same = [F.col(x) == F.col(v), *(F.col(c).eqNullSafe(F.col(k)) for c, k in of.items())]
    return df.join(ranks, same).drop(v, *of.values())


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """By group: spearman, over the rows where neither is null."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = with_average_rank(with_average_rank(own, "rx", "x", *by), "ry", "y", *by)
    return ranked.groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def empirical_p(at_least: Column, n: Column) -> Column:
    return (at_least + F.lit(1.0)) / (n + F.lit(1.0))
