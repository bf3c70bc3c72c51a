"""Windowed document prevalence of keys on two sides (human, model), its differences and log ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import jeffreys, numbered
from ..functions.tokens import is_stopword, key


def starts(span: Column, windows: int, policy: str, jitter: Column | None = None) -> Column:
    """Window starts (from 0) for a span of length minus window: first, last, or stratified quantiles."""
    if policy == "first":
        return F.array(F.lit(0))
    if policy == "last":
        return F.array(span)
    if policy != "quantile":
        raise ValueError(f"unknown policy {policy}")

    def at(m: int) -> Column:
        q = F.lit((m + 0.5) / windows)
        if jitter is not None:
            q = F.least(F.greatest(q + jitter[m], F.lit(0.0)), F.lit(1.0))
        return F.least(span, F.greatest(F.lit(0), F.floor(q * span).cast("int")))

    return F.array(*(at(m) for m in range(windows)))


def hashed_jitter(pair: Column, side: str, windows: int, seed: int) -> Column:
    """Uniform in [-1/2M, 1/2M), from a hash of pair, side, window and seed: the same on every run."""
    drawn = lambda m: F.conv(F.substring(F.md5(F.concat_ws("|", pair, F.lit(side), F.lit(str(m)), F.lit(str(seed)))), 1, 7), 16, 10).cast("double")
    return F.array(*((drawn(m) / float(1 << 28) - 0.5) / windows for m in range(windows)))


def eligible(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.where((F.size("h") >= k) & (F.size("m") >= k))


def _keys_from(side: str, k: int, exclude, kind: str, lower: bool):
    """From a start, the different keys of the window there."""

    def keys(start: Column) -> Column:
        cut = F.slice(F.col(side), start + 1, k)
        if exclude:
            cut = F.filter(cut, lambda t: ~F.coalesce(t["upos"], F.lit("")).isin(*exclude))
        return F.array_distinct(F.transform(cut, lambda t: key(t, kind, lower)))

    return keys


def window_keys(pairs: DataFrame, k: int = 12, windows: int = 1, policy: str = "quantile", trim: bool = False, exclude=(), jitter_seed: int | None = None, kind: str = "lemma_pos", lower: bool = True) -> DataFrame:
    """(by..., pair_id, side, w, key): different keys of each window of the pairs (pair_id, h, m and more) that are long enough.

    Excluded parts of speech hold their places in a window, and are left out after it is cut.
    """
    own = eligible(pairs, k)
    out = None
    by = [c for c in pairs.columns if c not in ("h", "m")]
    for side in ("h", "m"):
        span = F.size(side) - k
        if trim:
            span = F.least(F.size("h") - k, F.size("m") - k)
        jitter = hashed_jitter(F.col("pair_id"), side, windows, jitter_seed) if jitter_seed is not None else None

        cut = F.transform(starts(span, windows, policy, jitter), _keys_from(side, k, exclude, kind, lower))
        part = own.select(*by, F.lit(side).alias("side"), F.posexplode(cut).alias("w", "keys")).select(*by, "side", "w", F.explode("keys").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def wlas(pairs: DataFrame, by: tuple[str, ...] = (), k: int = 12, windows: int = 1, **how) -> DataFrame:
    """(by..., key, n_pairs, c_H, c_M, ell_H, ell_M, LAS, pp_MH, relpct_MH): a row a key seen in a window of either side."""
    n = eligible(pairs, k).groupBy(*by).agg(F.count("*").alias("n_pairs"))
    per = 1 if how.get("policy") in ("first", "last") else windows
    seen = window_keys(pairs, k, windows, **how).groupBy(*by, "key").agg(F.count_if(F.col("side") == "h").alias("h"), F.count_if(F.col("side") == "m").alias("m"))
    seen = seen.join(n, list(by)) if by else seen.crossJoin(F.broadcast(n))  # without groups n is one row
    return differences(seen.select(*by, "key", "n_pairs", (F.col("h") / F.lit(float(per))).alias("c_H"), (F.col("m") / F.lit(float(per))).alias("c_M")))


def sweep(pairs: DataFrame, sizes: tuple[int, ...], by: tuple[str, ...] = (), **how) -> DataFrame:
    """wlas() for several window sizes in one frame, told apart by k."""
    out = None
    for k in sizes:
        part = wlas(pairs, by, k, **how).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def differences(counts: DataFrame, floor: float = 1e-9) -> DataFrame:
    own = counts.withColumns({"ell_H": jeffreys(F.col("c_H"), F.col("n_pairs")), "ell_M": jeffreys(F.col("c_M"), F.col("n_pairs"))})
    own = own.withColumn("LAS", F.col("ell_M") - F.col("ell_H"))
    return own.withColumns({"pp_MH": F.col("LAS") * 100, "relpct_MH": F.col("LAS") * 100 / F.greatest(F.col("ell_H"), F.lit(floor))})


def with_lpr(table: DataFrame, alpha: float = 0.5, least: float = 20.0) -> DataFrame:
    """Adds ell_ratio_MH, count_ratio_MH, lpr_MH, lpr_guard_ok and lpr_MH_guarded (0 where the guard fails)."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    ok = F.col("c_M") >= least
    own = table.withColumns({"ell_ratio_MH": F.col("ell_M") / F.greatest(F.col("ell_H"), F.lit(1e-15)), "count_ratio_MH": (F.col("c_M") + alpha) / (F.col("c_H") + alpha), "lpr_guard_ok": ok.cast("int")})
    own = own.withColumn("lpr_MH", F.ln("count_ratio_MH"))
    return own.withColumn("lpr_MH_guarded", F.when(ok, F.col("lpr_MH")).otherwise(0.0))


def ranked(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank_LAS, and rank_LPR where there is a ratio: from the largest, ties by key. The ratio orders as its logarithm does."""
    orders = {"rank_LAS": F.col("LAS")}
    if "count_ratio_MH" in table.columns:
        orders["rank_LPR"] = F.when(F.col("lpr_guard_ok") == 1, F.col("count_ratio_MH")).otherwise(1.0)
    for name, value in orders.items():
        table = table.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(value.desc(), "key"))) if by else numbered(table, name, value)
    return table


def quality(pairs: DataFrame, table: DataFrame, k: int = 12) -> DataFrame:
    """One row: n_pairs, n_eligible, dropped_short, unique_keys, n_positive."""
    p = pairs.agg(F.count("*").alias("n_pairs"), F.count_if((F.size("h") >= k) & (F.size("m") >= k)).alias("n_eligible"))
    t = table.agg(F.count("*").alias("unique_keys"), F.count_if(F.col("LAS") > 0).alias("n_positive"))
    return p.crossJoin(t).select("n_pairs", "n_eligible", (F.col("n_pairs") - F.col("n_eligible")).alias("dropped_short"), "unique_keys", "n_positive")  # a row each


def macro(tables: DataFrame) -> DataFrame:
    """tables has a row a model and key: the mean prevalences over the models that have the key."""
    own = tables.groupBy("key").agg(F.avg("ell_H").alias("ell_H"), F.avg("ell_M").alias("ell_M"), F.bround(F.avg("n_pairs")).cast("int").alias("n_pairs"), F.count("*").alias("n_models"))
    own = own.withColumn("LAS", F.col("ell_M") - F.col("ell_H"))
    return own.withColumns({"pp_MH": F.col("LAS") * 100, "relpct_MH": F.col("LAS") * 100 / F.greatest(F.col("ell_H"), F.lit(1e-3))})


def micro(tables: DataFrame) -> DataFrame:
    """Counts and pairs summed over the models that have the key, then prevalences anew."""
    return differences(tables.groupBy("key").agg(F.sum("c_H").alias("c_H"), F.sum("c_M").alias("c_M"), F.sum("n_pairs").alias("n_pairs")), 1e-3)


def selected(table: DataFrame, positive: bool = True, floor: float | None = None) -> DataFrame:
    """The keys that scores are averaged over: all or those with LAS > 0, with at least `floor` of human prevalence."""
    out = table.where("LAS > 0") if positive else table
    return out.where(F.col("ell_H") >= floor) if floor is not None else out


def corpus_score(table: DataFrame) -> DataFrame:
    """pLAS (mean) and pLAS_pos (mean of what is positive); null over no keys."""
    return table.agg(F.avg("LAS").alias("pLAS"), F.avg(F.greatest(F.col("LAS"), F.lit(0.0))).alias("pLAS_pos"), F.count("*").alias("n_keys"))


def output(table: DataFrame, exclude=(), stopwords: bool = False, top: int | None = None) -> DataFrame:
    """Rows to write: exclusions after ranking, then the best by rank_LAS."""
    out = table.where(~F.element_at(F.split("key", "_"), -1).isin(*exclude)) if exclude else table
    if stopwords:
        out = out.where(~is_stopword(F.regexp_extract("key", "^(.*)_[^_]*$", 1), F.col("key")))
    return out.orderBy("rank_LAS").limit(top) if top else out


def first_seen(pairs: DataFrame, order: list[str], k: int = 12, kind: str = "lemma_pos") -> DataFrame:
    """(key, lemma, form, upos) as first met: by pair (order), human side first, then place in the window."""
    own = eligible(pairs, k)
    rows = None
    for n, side in enumerate(("h", "m")):
        start = F.floor((F.size(side) - k) * 0.5).cast("int")
        part = own.select(*order, F.lit(n).alias("side"), F.posexplode(F.slice(F.col(side), start + 1, k)).alias("place", "t"))
        rows = part if rows is None else rows.unionByName(part)
    at = F.struct(*order, "side", "place")
    return rows.withColumn("key", key(F.col("t"), kind, True)).groupBy("key").agg(F.min_by("t", at).alias("t")).select("key", "t.lemma", "t.form", "t.upos")
