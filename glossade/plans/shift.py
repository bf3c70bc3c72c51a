"""Queries that carry over-used words to periods and languages: shares, occurrences per million, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, counts, prevalence, selection
from . import sql
from .inputs import ASCII_SPACE, discovered, key_counts, pairs, period, table, vectors, word_totals, words
from .registry import query
from .words import NEUTRAL_SQL, tagged

_SHARES = f"""{sql.DISCOVERED}, {NEUTRAL_SQL}, {sql.DOC_KEYS},
kc AS (SELECT lang, key, count(*) FILTER (period = 'pre') AS count_pre, count(*) FILTER (period = 'post') AS count_post FROM doc_keys GROUP BY lang, key),
tot AS (SELECT lang, sum(count_pre)::BIGINT AS total_pre, sum(count_post)::BIGINT AS total_post FROM kc GROUP BY lang),
list AS (SELECT 'ai' AS grp, key FROM ranked WHERE rank_LAS <= 50 UNION ALL SELECT 'base', key FROM neutral),
g AS (SELECT tot.lang, grp, coalesce(sum(count_pre), 0)::BIGINT AS count_pre, coalesce(sum(count_post), 0)::BIGINT AS count_post, any_value(total_pre) AS total_pre, any_value(total_post) AS total_post FROM list CROSS JOIN tot LEFT JOIN kc ON kc.lang = tot.lang AND kc.key = list.key GROUP BY tot.lang, grp),
s AS (SELECT *, coalesce(count_pre / nullif(total_pre, 0)::DOUBLE, 0.0) AS share_pre, coalesce(count_post / nullif(total_post, 0)::DOUBLE, 0.0) AS share_post,
 {sql.chi2('count_pre::DOUBLE', '(total_pre - count_pre)::DOUBLE', 'count_post::DOUBLE', '(total_post - count_post)::DOUBLE')} AS chi2 FROM g)"""


def _shares(spark, sf):
    found = discovered(spark, sf)
    listed = selection.top_words(found, 50).select(F.lit("ai").alias("grp"), "key").unionByName(selection.neutral(found, 50, 42).select(F.lit("base").alias("grp"), "key"))
    by = key_counts(spark, sf, lang=F.col("lang"), period=period())
    wide = counts.pivoted(by, ["lang", "key"], "period", ["pre", "post"])
    total = wide.groupBy("lang").agg(F.sum("count_pre").alias("total_pre"), F.sum("count_post").alias("total_post"))
    words = listed.crossJoin(F.broadcast(total.select("lang")))  # 100 words by the languages
    return counts.group_share(words, wide, total, ["lang"])


@query(f"WITH {_SHARES} SELECT lang, grp, count_pre, count_post, total_pre, total_post, share_pre, share_post, coalesce((share_post - share_pre) / nullif(share_pre, 0), 0.0) AS growth FROM s")
def market_share(spark, sf):
    return _shares(spark, sf).select("lang", "grp", "count_pre", "count_post", "total_pre", "total_post", "share_pre", "share_post", "growth")


@query(f"WITH {_SHARES} SELECT lang, grp, round(chi2, 6) AS chi2, coalesce(chi2 > 10.827566170662733::DOUBLE, false) AS significant FROM s")
def share_chi2(spark, sf):
    return _shares(spark, sf).select("lang", "grp", F.round("chi2", 6).alias("chi2"), "significant")


@query()
def share_p_values(spark, sf):
    return counts.with_p(_shares(spark, sf)).select("lang", "grp", "chi2", "p_value", "significant")


@query(f"WITH {_SHARES}, g2 AS (SELECT grp, coalesce((share_post - share_pre) / nullif(share_pre, 0), 0.0) AS growth FROM s) SELECT grp, count(*) AS n_languages, round(avg(growth), 9) AS mean_growth FROM g2 GROUP BY grp")
def mean_growth(spark, sf):
    own = counts.mean_growth(_shares(spark, sf), ["grp"])
    return own.select("grp", "n_languages", F.round("mean_growth", 9).alias("mean_growth"))


@query(f"WITH {sql.DOC_KEYS} SELECT lang FROM doc_keys WHERE period = 'pre' INTERSECT SELECT lang FROM doc_keys WHERE period = 'post'")
def shared_languages(spark, sf):
    own = table(spark, sf, "documents").where(F.size(words(F.col("text"), ASCII_SPACE)) > 0).select("lang", period().alias("period"))
    return selection.shared(own.where("period = 'pre'"), own.where("period = 'post'"), "lang")


_PRE, _POST = ["src0", "src1", "src2"], ["src17", "src18", "src19"]
_PERIODS = f"""{sql.DOC_KEYS}, pc AS (SELECT source AS period, key, count(*) AS n FROM doc_keys GROUP BY source, key), pt AS (SELECT period AS p, sum(n)::BIGINT AS total FROM pc GROUP BY period)"""


def _sum(of: str, names: list[str]) -> str:
    return "(" + " + ".join(of.format(n) for n in names) + ")"


@query(
    f"WITH {sql.DISCOVERED}, {_PERIODS}, w AS (SELECT r.key, " + ", ".join(f"coalesce(sum(n) FILTER (period = '{p}'), 0)::BIGINT AS {p}" for p in [*_PRE, *_POST]) + " FROM ranked r LEFT JOIN pc ON pc.key = r.key GROUP BY r.key), "
    "tt AS (SELECT " + ", ".join(f"any_value(total) FILTER (p = '{p}')::DOUBLE AS t_{p}" for p in [*_PRE, *_POST]) + " FROM pt), "
    "x AS (SELECT key, " + f"{_sum('{0} / t_{0}', _PRE)} / 3.0::DOUBLE AS rel_pre, {_sum('{0} / t_{0}', _POST)} / 3.0::DOUBLE AS rel_post, {_sum('{0}', _PRE)} AS count_pre, {_sum('{0}', _POST)} AS count_post, {_sum('t_{0}', _PRE)} AS tp, {_sum('t_{0}', _POST)} AS tq FROM w, tt) "
    f"SELECT key, round(rel_pre, 12) AS rel_pre, round(rel_post, 12) AS rel_post, count_pre, count_post, coalesce({sql.chi2('count_pre::DOUBLE', '(tp - count_pre)', 'count_post::DOUBLE', '(tq - count_post)')} > 10.827566170662733::DOUBLE, false) AS significant FROM x"
)
def annotate_shift(spark, sf):
    by = key_counts(spark, sf, period=F.col("source"))
    own = counts.macro_relative(by, counts.totals(by, ["period"]), discovered(spark, sf).select("key"), "period", _PRE, _POST)
    return own.select("key", F.round("rel_pre", 12).alias("rel_pre"), F.round("rel_post", 12).alias("rel_post"), "count_pre", "count_post", "significant")


_WEEK = "'w' || ((day(ts) - 1) // 7)"
_OPM = f"""ev AS (SELECT {_WEEK} AS period, event_type AS key, count(*) AS count FROM events GROUP BY ALL), tot AS (SELECT period, sum(count)::BIGINT AS total FROM ev GROUP BY period)"""


def _events(spark, sf):
    week = F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    return counts.count_keys(table(spark, sf, "events").select(week.alias("period"), F.col("event_type").alias("key")), ["period"])


@query(f"WITH {_OPM} SELECT key, period, count, total, count / total * 1e6::DOUBLE AS opm FROM ev JOIN tot USING (period)")
def opm_by_period(spark, sf):
    own = _events(spark, sf)
    return own.join(counts.totals(own, ["period"]), "period").select("key", "period", "count", "total", counts.opm(F.col("count"), F.col("total")).alias("opm"))


#: The rule tags words, so these count as content.
_TAGS = ("WORD",)
_SEEDS = """content AS (SELECT * FROM ranked WHERE lpr_guard_ok = 1 AND upos IN ('WORD')),
chosen AS (SELECT key, upos FROM (SELECT key, upos, row_number() OVER (ORDER BY count_ratio_MH DESC, key) AS n FROM content) WHERE n <= 50),
quota AS (SELECT upos, count(*) AS quota FROM chosen GROUP BY upos),
matched AS (SELECT key, upos FROM (SELECT key, upos, row_number() OVER (PARTITION BY upos ORDER BY abs(LAS), c_M DESC, key) AS n FROM content WHERE key NOT IN (SELECT key FROM chosen)) JOIN quota USING (upos) WHERE n <= quota),
seeds AS (SELECT 'ai' AS seed_type, key, upos FROM chosen UNION ALL SELECT 'baseline', key, upos FROM matched)"""


@query(f"WITH {sql.DISCOVERED}, {_SEEDS} SELECT seed_type, key, upos FROM seeds")
def content_seeds(spark, sf):
    return selection.seeds(tagged(spark, sf), 50, _TAGS).select("seed_type", "key", "upos")


@query(f"WITH {sql.PAIRS}, {sql.wlas(by='model')} SELECT model AS lang, key, row_number() OVER (PARTITION BY model ORDER BY count_ratio_MH DESC, key) AS lpr_rank FROM t WHERE lpr_guard_ok = 1 AND model <> 0")
def guarded_targets(spark, sf):
    """Tables of three models stand for those of three languages; the first is left out."""
    tables = prevalence.with_lpr(prevalence.wlas(pairs(spark, sf), ("model",))).withColumnRenamed("model", "lang")
    return align.guarded_targets(tables, ("0",)).select("lang", "key", "lpr_rank")


_CHANGE = f"""m AS (SELECT *, {_sum('opm_{0}', _PRE)} / 3 AS opm_pre, {_sum('opm_{0}', _POST)} / 3 AS opm_post FROM o),
c AS (SELECT *, (opm_post - opm_pre) / nullif(opm_pre, 0) * 100 AS pct_change FROM m)"""
_TERM_OPM = f"""{sql.DISCOVERED}, {_SEEDS}, {_PERIODS},
o AS (SELECT seed_type, s.key, """ + ", ".join(f"coalesce(any_value(n) FILTER (period = '{p}'), 0) / (SELECT total FROM pt WHERE p = '{p}') * 1e6::DOUBLE AS opm_{p}" for p in [*_PRE, *_POST]) + f""" FROM seeds s LEFT JOIN pc ON pc.key = s.key GROUP BY seed_type, s.key),
{_CHANGE}"""


def _term_opm(spark, sf):
    seeds = selection.seeds(tagged(spark, sf), 50, _TAGS).select("seed_type", "key")
    by = key_counts(spark, sf, period=F.col("source"))
    met = seeds.join(by, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return counts.opm_table(met, word_totals(spark, sf, period=F.col("source")), "period", _PRE, _POST, ["seed_type", "key"])


@query(f"WITH {_TERM_OPM} SELECT seed_type, key, round(opm_pre, 6) AS opm_pre, round(opm_post, 6) AS opm_post, round(pct_change, 6) AS pct_change FROM c")
def opm_pct_change(spark, sf):
    return _term_opm(spark, sf).select("seed_type", "key", *(F.round(c, 6).alias(c) for c in ("opm_pre", "opm_post", "pct_change")))


@query(f"WITH {_TERM_OPM} SELECT seed_type, count(*) AS n_words, round(avg(pct_change), 6) AS mean_pct_change, round(median(pct_change), 6) AS median_pct_change FROM c GROUP BY seed_type")
def opm_summary(spark, sf):
    own = counts.change_summary(_term_opm(spark, sf), ["seed_type"])
    return own.select("seed_type", "n_words", *(F.round(c, 6).alias(c) for c in ("mean_pct_change", "median_pct_change")))


_BY_LANGUAGE = f"""{sql.DISCOVERED}, {_SEEDS}, {sql.DOC_KEYS}, side AS (SELECT lang, key, period, count(*) AS n FROM doc_keys GROUP BY ALL), total AS (SELECT lang, period, sum(n)::BIGINT AS total FROM side GROUP BY ALL),
langs AS (SELECT lang, any_value(total) FILTER (period = 'pre') AS t_pre, any_value(total) FILTER (period = 'post') AS t_post FROM total GROUP BY lang),
o AS (SELECT l.lang, seed_type, s.key, coalesce(any_value(n) FILTER (period = 'pre'), 0) / any_value(t_pre) * 1e6::DOUBLE AS opm_pre, coalesce(any_value(n) FILTER (period = 'post'), 0) / any_value(t_post) * 1e6::DOUBLE AS opm_post
 FROM seeds s CROSS JOIN langs l LEFT JOIN side ON side.key = s.key AND side.lang = l.lang GROUP BY l.lang, seed_type, s.key),
c AS (SELECT *, (opm_post - opm_pre) / nullif(opm_pre, 0) * 100 AS pct_change FROM o),
ls AS (SELECT lang, count(*) FILTER (seed_type = 'ai') AS n_ai_words, count(*) FILTER (seed_type = 'baseline') AS n_baseline_words, avg(pct_change) FILTER (seed_type = 'ai') AS mean_pct_change_ai, median(pct_change) FILTER (seed_type = 'ai') AS median_pct_change_ai,
 avg(pct_change) FILTER (seed_type = 'baseline') AS mean_pct_change_baseline, median(pct_change) FILTER (seed_type = 'baseline') AS median_pct_change_baseline FROM c GROUP BY lang)"""
_SUMMARY = ["mean_pct_change_ai", "median_pct_change_ai", "mean_pct_change_baseline", "median_pct_change_baseline"]


def _language_summary(spark, sf):
    """Occurrences per million of the seeds before and after, in each language."""
    by = key_counts(spark, sf, lang=F.col("lang"), period=period())
    wide = counts.pivoted(by, ["lang", "key"], "period", ["pre", "post"])
    words_of = word_totals(spark, sf, lang=F.col("lang"), period=period())
    total = words_of.groupBy("lang").agg(*(F.coalesce(F.sum(F.when(F.col("period") == p, F.col("total"))), F.lit(0)).alias(f"total_{p}") for p in ("pre", "post")))
    seeds = selection.seeds(tagged(spark, sf), 50, _TAGS).select("seed_type", "key")
    every = seeds.crossJoin(F.broadcast(total)).join(wide, ["lang", "key"], "left")  # a hundred seeds by the languages
    own = every.select("lang", "seed_type", "key", *(counts.opm(F.coalesce(f"count_{p}", F.lit(0)), F.col(f"total_{p}")).alias(f"opm_{p}") for p in ("pre", "post")))
    return counts.language_summary(own.withColumn("pct_change", F.try_divide(F.col("opm_post") - F.col("opm_pre"), F.nullif("opm_pre", F.lit(0.0))) * 100))


@query(f"WITH {_BY_LANGUAGE} SELECT lang, n_ai_words, n_baseline_words, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUMMARY) + " FROM ls")
def opm_language_summary(spark, sf):
    return _language_summary(spark, sf).select("lang", "n_ai_words", "n_baseline_words", *(F.round(c, 6).alias(c) for c in _SUMMARY))


@query(f"WITH {_BY_LANGUAGE} SELECT count(*) AS n_languages, round(avg(mean_pct_change_ai), 6) AS mean_of_means_ai, round(median(median_pct_change_ai), 6) AS median_of_medians_ai, round(avg(mean_pct_change_baseline), 6) AS mean_of_means_baseline, round(median(median_pct_change_baseline), 6) AS median_of_medians_baseline, count(*) FILTER (mean_pct_change_ai > mean_pct_change_baseline) AS n_ai_higher FROM ls")
def opm_across_languages(spark, sf):
    own = counts.across_languages(_language_summary(spark, sf))
    return own.select("n_languages", *(F.round(c, 6).alias(c) for c in ("mean_of_means_ai", "median_of_medians_ai", "mean_of_means_baseline", "median_of_medians_baseline")), "n_ai_higher")


@query(f"""WITH {_OPM}, e AS (SELECT DISTINCT key FROM ev), g AS (SELECT key, period, coalesce(count, 0) / total * 1e6::DOUBLE AS opm FROM e CROSS JOIN tot LEFT JOIN ev USING (key, period)),
b AS (SELECT key, sum(opm) FILTER (period IN ('w0', 'w1')) / 2 AS pre FROM g GROUP BY key) SELECT period, round(avg((opm - pre) / nullif(pre, 0) * 100), 6) AS mean_pct_change, count(pre) AS n_series FROM g JOIN b USING (key) GROUP BY period""")
def concept_panel(spark, sf):
    own = _events(spark, sf)
    total = counts.totals(own, ["period"])
    every = own.select("key").distinct().crossJoin(F.broadcast(total)).join(own, ["key", "period"], "left")  # a handful of weeks
    g = every.select("key", "period", (F.coalesce("count", F.lit(0)) / F.col("total") * 1e6).alias("opm"))
    b = g.groupBy("key").agg((F.sum(F.when(F.col("period").isin("w0", "w1"), F.col("opm"))) / 2).alias("pre"))
    change = F.try_divide(F.col("opm") - F.col("pre"), F.nullif("pre", F.lit(0.0))) * 100
    return g.join(b, "key").groupBy("period").agg(F.round(F.avg(change), 6).alias("mean_pct_change"), F.count("pre").alias("n_series"))


_KS = [10, 50]


def _matches(spark, sf, most=max(_KS)):
    own = vectors(spark, sf)
    seeds = selection.top(own.where("label = 0"), 20, [F.col("vec_id")]).select(F.col("vec_id").alias("seed"), "vec")
    targets = align.ranked_targets(own.where("label > 0").select(F.col("label").alias("lang"), F.col("vec_id").alias("target"), "vec"), [F.col("target")])
    return seeds, targets, align.similarities(seeds, targets, most)


_COS = "list_dot_product(s.v, t.v) / (sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(t.v, t.v)))"
_PAIRED = f"""vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x_: x_::DOUBLE) AS v FROM embeddings),
seeds AS (SELECT vec_id AS seed, v FROM vecs WHERE label = 0 ORDER BY vec_id LIMIT 20),
targets AS (SELECT label AS lang, vec_id AS target, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM vecs WHERE label > 0),
cs AS (SELECT seed, lang, target, rk, {_COS} AS cosine FROM seeds s CROSS JOIN targets t)"""
_BEST = "SELECT seed, lang, arg_max(target, cosine) AS matched, max(cosine) AS cosine, arg_max(rk, cosine) AS lpr_rank, max(cosine) FILTER (rk <= 10) AS max_cos_10, max(cosine) FILTER (rk <= 50) AS max_cos_50 FROM cs"
_ALIGN = f"{_PAIRED}, best AS ({_BEST} WHERE rk <= 50 GROUP BY seed, lang)"
#: The whole vocabulary of each language is searched.
_ALIGN_ALL = f"{_PAIRED}, best AS ({_BEST} GROUP BY seed, lang)"


@query(f"WITH {_ALIGN} SELECT seed, lang, matched, lpr_rank, round(cosine, 6) AS cosine, round(max_cos_10, 6) AS max_cos_10, round(max_cos_50, 6) AS max_cos_50, (max_cos_10 >= 0.3)::INT AS hit_at_10, (max_cos_50 >= 0.3)::INT AS hit_at_50 FROM best")
def align_restricted(spark, sf):
    own = align.restricted(_matches(spark, sf)[2], _KS)
    return own.select("seed", "lang", "matched", "lpr_rank", *(F.round(c, 6).alias(c) for c in ("cosine", "max_cos_10", "max_cos_50")), "hit_at_10", "hit_at_50")


@query(f"WITH {_ALIGN_ALL} SELECT seed, lang, CASE WHEN cosine >= 0.3 THEN matched END AS matched, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.3 THEN lpr_rank END AS lpr_rank, (cosine >= 0.3 AND lpr_rank <= 10)::INT AS hit_at_10, (cosine >= 0.3 AND lpr_rank <= 50)::INT AS hit_at_50 FROM best")
def align_unrestricted(spark, sf):
    own = align.unrestricted(_matches(spark, sf, None)[2], _KS, 0.3)
    return own.withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_ALIGN} SELECT seed, round(avg(max_cos_10), 6) AS mean_max_cos_10, round(avg(max_cos_50), 6) AS mean_max_cos_50, sum((max_cos_10 >= 0.3)::INT)::BIGINT AS n_langs_hit_10, sum((max_cos_50 >= 0.3)::INT)::BIGINT AS n_langs_hit_50, array_to_string(list_transform(list_slice(list_reverse_sort(list({{'c': cosine, 'l': lang, 'm': matched}})), 1, 3), lambda x_: x_.l::VARCHAR || ':' || x_.m::VARCHAR), '; ') AS example_matches FROM best GROUP BY seed")
def seed_summary(spark, sf):
    own = align.seed_summary(align.restricted(_matches(spark, sf)[2], _KS), _KS)
    return own.select("seed", *(F.round(f"mean_max_cos_{k}", 6).alias(f"mean_max_cos_{k}") for k in _KS), *(f"n_langs_hit_{k}" for k in _KS), "example_matches")


@query(f"WITH {_ALIGN} SELECT lang, count(*) AS n_seeds, round(avg(max_cos_10), 6) AS mean_max_cos_10, round(avg(max_cos_50), 6) AS mean_max_cos_50 FROM best GROUP BY lang")
def lang_summary(spark, sf):
    own = align.lang_summary(align.restricted(_matches(spark, sf)[2], _KS), _KS)
    return own.select("lang", "n_seeds", *(F.round(f"mean_max_cos_{k}", 6).alias(f"mean_max_cos_{k}") for k in _KS))


_METRICS = [f"{what}_{k}" for k in _KS for what in ("mean_cos", "hit_at")]
_WORDS = _PAIRED.replace("WHERE label = 0 ORDER BY vec_id LIMIT 20", "WHERE label = 0")


def _null_sql(best: str, values: dict[str, str]) -> str:
    each = ", ".join(f"round(avg({x}), 6) AS {m}" for m, x in values.items())
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(any_value(o.{m}), 6) AS observed, avg(round(n.{m}, 6)) AS null_mean, stddev_pop(round(n.{m}, 6)) AS null_std, (count(*) FILTER (round(n.{m}, 6) >= round(o.{m}, 6)) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM nul n CROSS JOIN seen o" for m in values)
    return f"""WITH {_WORDS}, best AS ({best} GROUP BY seed, lang), val AS (SELECT seed AS word, 'p' || (seed % 4) AS upos, {each} FROM best GROUP BY seed),
obs AS (SELECT * FROM val ORDER BY word LIMIT 20), quota AS (SELECT upos, count(*) AS quota FROM obs GROUP BY upos),
seen AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in values)} FROM obs),
drawn AS (SELECT perm, val.*, row_number() OVER (PARTITION BY perm, upos ORDER BY md5(concat_ws('|', '42', perm, word)), word) AS n FROM val CROSS JOIN range(100) r(perm)),
nul AS (SELECT perm, {', '.join(f'avg({m}) AS {m}' for m in values)} FROM drawn JOIN quota USING (upos) WHERE n <= quota GROUP BY perm), told AS ({rows})
SELECT metric, observed, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(CASE WHEN null_std > 1e-12::DOUBLE THEN (observed - null_mean) / null_std ELSE 'inf'::DOUBLE END, 4) AS z, p_value FROM told"""


def _null(spark, sf, most):
    own = vectors(spark, sf)
    words = own.where("label = 0").select(F.col("vec_id").alias("seed"), "vec")
    targets = _matches(spark, sf)[1]
    best = align.restricted(align.similarities(words, targets, most), _KS) if most else align.unrestricted(align.searched(words, targets), _KS, 0.3)
    value = align.word_values(best, _KS).select(F.col("seed").alias("word"), F.concat(F.lit("p"), (F.col("seed") % 4).cast("string")).alias("upos"), *(F.round(m, 6).alias(m) for m in _METRICS))
    seen = selection.top(value, 20, [F.col("word")])
    null = align.permutation_null(value, seen.groupBy("upos").agg(F.count("*").alias("quota")), 100, 42, _METRICS)
    rounded = lambda df, *more: df.select(*more, *(F.round(m, 6).alias(m) for m in _METRICS))
    out = align.null_summary(rounded(null, "perm"), rounded(seen.agg(*(F.avg(m).alias(m) for m in _METRICS))), _METRICS)
    return out.select("metric", "observed", *(F.round(c, 6).alias(c) for c in ("null_mean", "null_std")), F.round("z", 4).alias("z"), "p_value")


@query(_null_sql(f"{_BEST} WHERE rk <= 50", {f"mean_cos_{k}": f"max_cos_{k}" for k in _KS} | {f"hit_at_{k}": f"(max_cos_{k} >= 0.3)::INT" for k in _KS}))
def permutation_null(spark, sf):
    return _null(spark, sf, max(_KS))


@query(_null_sql(_BEST, {f"mean_cos_{k}": "cosine" for k in _KS} | {f"hit_at_{k}": f"(cosine >= 0.3 AND lpr_rank <= {k})::INT" for k in _KS}))
def permutation_null_unrestricted(spark, sf):
    return _null(spark, sf, None)
