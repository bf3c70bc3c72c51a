"""Key counts by period, shares, occurrences per million, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import CHI2_001, chi2_p, yates_chi2


def count_keys(keys: DataFrame, by: list[str]) -> DataFrame:
    return keys.groupBy(*by, "key").agg(F.count("*").alias("count"))


def count_words(texts: DataFrame, by: list[str], words: Column, key) -> DataFrame:
    """(by..., key, count) of arrays of words. Words are counted as they stand first, so that a key (a function of a word) is made once a different word."""
    raw = texts.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("count"))
    return raw.select(*by, key(F.col("word")).alias("key"), "count").groupBy(*by, "key").agg(F.sum("count").alias("count"))


def totals(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("count").alias("total"))


def pivoted(counts: DataFrame, by: list[str], period: str, values: list[str]) -> DataFrame:
    """(by..., count_<value>...): 0 where a period has none."""
    return counts.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col(period) == v, F.col("count"))), F.lit(0)).alias(f"count_{v}") for v in values))


def group_share(words: DataFrame, counts: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grp, count_pre, count_post, total_pre, total_post, share_pre, share_post, growth, chi2, significant).

    words (by..., grp, key) is a list: a key named twice counts twice. counts and total have count_/total_ pre and post.
    """
    own = words.join(counts, [*by, "key"], "left").groupBy(*by, "grp").agg(*(F.coalesce(F.sum(f"count_{p}"), F.lit(0)).alias(f"count_{p}") for p in ("pre", "post")))
    own = own.join(total, by) if by else own.crossJoin(F.broadcast(total))  # one row
    return changes(own)


def changes(own: DataFrame) -> DataFrame:
    """Adds share_pre, share_post, growth (0 from nothing), chi2 and significant (p < 0.001) to counts and totals of pre and post."""
    share = {p: F.coalesce(F.try_divide(F.col(f"count_{p}"), F.col(f"total_{p}")), F.lit(0.0)) for p in ("pre", "post")}
    chi2 = yates_chi2(F.col("count_pre"), F.col("total_pre") - F.col("count_pre"), F.col("count_post"), F.col("total_post") - F.col("count_post"))
    own = own.withColumns({"share_pre": share["pre"], "share_post": share["post"], "chi2": chi2})
    growth = F.coalesce(F.try_divide(F.col("share_post") - F.col("share_pre"), F.col("share_pre")), F.lit(0.0))
    return own.withColumns({"growth": growth, "significant": F.coalesce(F.col("chi2") > CHI2_001, F.lit(False))})


def mean_growth(shares: DataFrame, by: list[str]) -> DataFrame:
    """The mean of growth over what shares has a row for (languages), by group."""
    return shares.groupBy(*by).agg(F.count("*").alias("n_languages"), F.avg("growth").alias("mean_growth"))


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", chi2_p(F.col("chi2")))


def opm(count: Column, total: Column) -> Column:
    """Occurrences per million; null without a total."""
    return F.try_divide(count, F.nullif(total, F.lit(0))) * 1e6


def _beside(wide: DataFrame, total: DataFrame, period: str, values: list[str]) -> DataFrame:
    """wide with the columns size_<value>: each period's total, null where there is none."""
    sizes = total.groupBy().agg(*(F.sum(F.when(F.col(period) == v, F.col("total"))).alias(f"size_{v}") for v in values))
    return wide.crossJoin(F.broadcast(sizes))  # one row


def opm_table(counts: DataFrame, total: DataFrame, period: str, pre: list[str], post: list[str], by: list[str]) -> DataFrame:
    """(by..., opm_<period>..., opm_pre, opm_post, pct_change): means over the periods that exist; the change is null from nothing."""
    every = [*pre, *post]
    wide = _beside(pivoted(counts, by, period, every), total, period, every)
    own = wide.select(*by, *(opm(F.col(f"count_{v}"), F.col(f"size_{v}")).alias(f"opm_{v}") for v in every))

    def mean(values: list[str]) -> Column:
        cols = [F.col(f"opm_{v}") for v in values]
        return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0)))

    own = own.withColumns({"opm_pre": mean(pre), "opm_post": mean(post)})
    return own.withColumn("pct_change", F.try_divide(F.col("opm_post") - F.col("opm_pre"), F.nullif("opm_pre", F.lit(0.0))) * 100)


def macro_relative(counts: DataFrame, total: DataFrame, keys: DataFrame, period: str, pre: list[str], post: list[str]) -> DataFrame:
    """(key, rel_pre, rel_post, pct_change, count_pre, count_post): mean relative frequency over the periods that exist (a missing key is 0 there), and pooled counts."""
    wide = _beside(keys.join(pivoted(counts, ["key"], period, [*pre, *post]), "key", "left"), total, period, [*pre, *post])
    at = lambda v: F.coalesce(F.col(f"count_{v}"), F.lit(0))
    size = lambda v: F.coalesce(F.col(f"size_{v}"), F.lit(0))

    def rel(values: list[str]) -> Column:
        there = sum((F.when(size(v) > 0, 1).otherwise(0) for v in values), F.lit(0))
        return sum((F.coalesce(F.try_divide(at(v), F.nullif(size(v).cast("double"), F.lit(0.0))), F.lit(0.0)) for v in values), F.lit(0.0)) / F.greatest(there, F.lit(1)).cast("double")

    names = {"pre": pre, "post": post}
    own = wide.select("key", *(rel(vs).alias(f"rel_{p}") for p, vs in names.items()), *(sum((at(v) for v in vs), F.lit(0)).alias(f"count_{p}") for p, vs in names.items()), *(sum((size(v) for v in vs), F.lit(0)).cast("long").alias(f"total_{p}") for p, vs in names.items()))
    chi2 = yates_chi2(F.col("count_pre"), F.col("total_pre") - F.col("count_pre"), F.col("count_post"), F.col("total_post") - F.col("count_post"))
    change = F.coalesce(F.try_divide(F.col("rel_post") - F.col("rel_pre"), F.nullif("rel_pre", F.lit(0.0))), F.lit(0.0))
    return own.withColumns({"pct_change": change, "chi2": chi2}).withColumn("significant", F.coalesce(F.col("chi2") > CHI2_001, F.lit(False)))


def change_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    return changes.groupBy(*by).agg(F.count("*").alias("n_words"), F.avg("pct_change").alias("mean_pct_change"), F.median("pct_change").alias("median_pct_change"))


def language_summary(changes: DataFrame) -> DataFrame:
    """By lang, from rows (lang, seed_type, key, pct_change): n_<type>_words, mean_pct_change_<type>, median_pct_change_<type> for the types ai and baseline."""
    of = lambda t, c: F.when(F.col("seed_type") == t, c)
    cols = {"ai": "ai", "baseline": "baseline"}
    made = [F.count(of(t, F.lit(1))).alias(f"n_{n}_words") for t, n in cols.items()]
    for t, n in cols.items():
        made += [F.avg(of(t, F.col("pct_change"))).alias(f"mean_pct_change_{n}"), F.median(of(t, F.col("pct_change"))).alias(f"median_pct_change_{n}")]
    return changes.groupBy("lang").agg(*made)


def across_languages(summary: DataFrame) -> DataFrame:
    """One row from language_summary(): languages, the mean of their means and the median of their medians of each type, and in how many the mean of ai is above that of baseline."""
    made = [F.count("*").alias("n_languages")]
    for t in ("ai", "baseline"):
        made += [F.avg(f"mean_pct_change_{t}").alias(f"mean_of_means_{t}"), F.median(f"median_pct_change_{t}").alias(f"median_of_medians_{t}")]
    return summary.agg(*made, F.count_if(F.col("mean_pct_change_ai") > F.col("mean_pct_change_baseline")).alias("n_ai_higher"))
