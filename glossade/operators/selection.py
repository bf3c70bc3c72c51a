"""Which rows: sampling that every run repeats, top lists, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *cols: str) -> Column:
    """An order that depends on seed and values alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def sample_per(df: DataFrame, by: list[str], rows: int, seed: int, *identity: str) -> DataFrame:
    """At most `rows` rows of each group, drawn without replacement; identity names what tells rows apart."""
    w = Window.partitionBy(*by).orderBy(draw(seed, *by, *identity), *identity)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).drop("_n")


def top(df: DataFrame, n: int, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of each group, or of all; every task keeps its own first n."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_words(table: DataFrame, n: int, metric: str = "las", guard: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The most over-used keys: by rank_LAS (else LAS), or by the log ratio of those that pass the guard."""
    if metric == "las":
        order = [F.coalesce(F.col("rank_LAS").cast("double"), F.lit(1e18)).asc()] if "rank_LAS" in table.columns else [F.coalesce("LAS", F.lit(0.0)).desc()]
    elif metric == "lpr":
        if guard and "lpr_guard_ok" in table.columns:
            table = table.where("lpr_guard_ok = 1")
        order = [F.desc("count_ratio_MH")] if "count_ratio_MH" in table.columns else [F.coalesce("lpr_MH", F.lit(0.0)).desc()]
    else:
        raise ValueError("metric must be las or lpr")
    return top(table, n, [*order, F.col("key")], by)


def neutral(table: DataFrame, n: int, seed: int, metric: str = "LAS", frequency: str = "c_H", nearest: int = 2000, by: tuple[str, ...] = ()) -> DataFrame:
    """n keys drawn from the 2n most frequent of the `nearest` keys closest to neutral (fewer than n: all of those)."""
    near = top(table, nearest, [F.abs(F.coalesce(metric, F.lit(0.0))).asc(), F.col("key")], by)
    pool = top(near, 2 * n, [F.coalesce(frequency, F.lit(0.0)).desc(), F.col("key")], by)
    return top(pool, n, [draw(seed, *by, "key"), F.col("key")], by)


def matched_baseline(table: DataFrame, chosen: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As many keys of each part of speech as chosen has, none of them chosen: nearest to neutral first, then most frequent."""
    on = [*by, "upos"]
    quota = chosen.groupBy(*on).agg(F.count("*").alias("quota"))
    rest = table.join(chosen.select(*by, "key"), [*by, "key"], "left_anti")
    w = Window.partitionBy(*on).orderBy(F.abs("LAS"), F.desc("c_M"), "key")
    return rest.join(quota, on).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


# The parts of speech of content words.
CONTENT_UPOS = ("NOUN", "VERB", "ADJ", "ADV")


def content(table: DataFrame, tags: tuple[str, ...] = CONTENT_UPOS) -> DataFrame:
    """Content words whose log ratio passes the guard."""
    return table.where((F.col("lpr_guard_ok") == 1) & F.col("upos").isin(*tags))


def seeds(table: DataFrame, n: int, tags: tuple[str, ...] = CONTENT_UPOS, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of content() with a seed_type: ai, the n of the highest guarded log ratio, and baseline, as many others of each part of speech, nearest to neutral first."""
    own = content(table, tags)
    chosen = top(own, n, [F.desc("count_ratio_MH"), F.col("key")], by)  # the ratio orders as its logarithm does
    return chosen.withColumn("seed_type", F.lit("ai")).unionByName(matched_baseline(own, chosen, by).withColumn("seed_type", F.lit("baseline")).select(*chosen.columns, "seed_type"))


def distribution(chosen: DataFrame, by: str = "upos") -> DataFrame:
    """How many chosen keys there are of each part of speech."""
    return chosen.groupBy(by).agg(F.count("*").alias("count"))


def shared(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The values that a column has in both."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi")


def with_names(df: DataFrame, code: str, names: dict[str, str], name: str = "display_name") -> DataFrame:
    """df with a display name for each code; a code without one is its own name. names is a small table of the caller's."""
    table = df.sparkSession.createDataFrame([*names.items()] or [("", "")], f"{code} string, {name} string")
    return df.join(F.broadcast(table), code, "left").withColumn(name, F.coalesce(name, code))
