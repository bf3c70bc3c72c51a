"""Queries over pairs of human and model texts: prevalence differences, their aggregation, scores and explorer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import STOPWORDS_EN
from ..operators import explorer, prevalence, scoring, selection, similarity
from . import sql
from .inputs import discovered, line_keys, pairs
from .registry import query

_COLS = ["key", "n_pairs", "c_H", "c_M", "ell_H", "ell_M", "LAS", "rank_LAS"]
_RANK = "row_number() OVER (ORDER BY LAS DESC, key) AS rank_LAS"


def _discover_sql(**how) -> str:
    return f"WITH {sql.PAIRS}, {sql.wlas(**how)} SELECT key, n_pairs, c_H, c_M, ell_H, ell_M, LAS, {_RANK} FROM t"


def _discover(spark, sf, **how):
    return prevalence.ranked(prevalence.wlas(pairs(spark, sf), **how)).select(*_COLS)


@query(_discover_sql())
def discover_las(spark, sf):
    return _discover(spark, sf)


@query(f"WITH {sql.DISCOVERED} SELECT key, n_pairs, c_H, c_M, LAS, LAS * 100 AS pp_MH, LAS * 100 / greatest(ell_H, 1e-9::DOUBLE) AS relpct_MH, ell_M / greatest(ell_H, 1e-15::DOUBLE) AS ell_ratio_MH, count_ratio_MH, round(lpr_MH, 9) AS lpr_MH, lpr_guard_ok, round(lpr_MH_guarded, 9) AS lpr_MH_guarded, rank_LAS, rank_LPR FROM ranked")
def discover_lpr(spark, sf):
    own = discovered(spark, sf)
    return own.select("key", "n_pairs", "c_H", "c_M", "LAS", "pp_MH", "relpct_MH", "ell_ratio_MH", "count_ratio_MH", F.round("lpr_MH", 9).alias("lpr_MH"), "lpr_guard_ok", F.round("lpr_MH_guarded", 9).alias("lpr_MH_guarded"), "rank_LAS", "rank_LPR")


@query(_discover_sql(m=3))
def discover_multiwindow(spark, sf):
    return _discover(spark, sf, windows=3)


@query(_discover_sql(policy="first"))
def discover_first(spark, sf):
    return _discover(spark, sf, policy="first")


@query(_discover_sql(policy="last"))
def discover_last(spark, sf):
    return _discover(spark, sf, policy="last")


@query(_discover_sql(trim=True))
def discover_trim(spark, sf):
    return _discover(spark, sf, trim=True)


@query(_discover_sql(exclude=("PUNCT", "NUM")))
def discover_excluding(spark, sf):
    return _discover(spark, sf, exclude=("PUNCT", "NUM"))


@query(_discover_sql(m=3, jitter=42))
def discover_jitter(spark, sf):
    return _discover(spark, sf, windows=3, jitter_seed=42)


@query(f"WITH {sql.PAIRS}, {sql.wlas()} SELECT p.n_pairs, p.n_eligible, p.n_pairs - p.n_eligible AS dropped_short, k.unique_keys, k.n_positive FROM (SELECT count(*) AS n_pairs, count(*) FILTER (len(h) >= 12 AND len(m) >= 12) AS n_eligible FROM pairs) p, (SELECT count(*) AS unique_keys, count(*) FILTER (LAS > 0) AS n_positive FROM t) k")
def discover_qc(spark, sf):
    own = pairs(spark, sf)
    return prevalence.quality(own, prevalence.wlas(own))


@query(f"WITH {sql.PAIRS}, {sql.wlas()} SELECT round(avg(LAS), 9) AS pLAS, round(avg(greatest(LAS, 0.0::DOUBLE)), 9) AS pLAS_pos, count(*) AS n_keys FROM t WHERE LAS > 0 AND ell_H >= 0.005")
def plas_vstar(spark, sf):
    own = prevalence.corpus_score(prevalence.selected(prevalence.wlas(pairs(spark, sf)), True, 0.005))
    return own.select(F.round("pLAS", 9).alias("pLAS"), F.round("pLAS_pos", 9).alias("pLAS_pos"), "n_keys")


@query(f"WITH {sql.DISCOVERED} SELECT key, rank_LAS, LAS FROM ranked WHERE upos NOT IN ('PUNCT', 'NUM') ORDER BY rank_LAS LIMIT 100")
def output_exclusions_topk(spark, sf):
    return prevalence.output(discovered(spark, sf), ("PUNCT", "NUM"), top=100).select("key", "rank_LAS", "LAS")


@query(f"WITH {sql.DISCOVERED} SELECT key, rank_LAS FROM ranked WHERE lower(regexp_extract(key, '^(.*)_[^_]*$', 1)) NOT IN ({', '.join(map(sql.q, sorted(STOPWORDS_EN)))})")
def output_without_stopwords(spark, sf):
    return prevalence.output(discovered(spark, sf), stopwords=True).select("key", "rank_LAS")


_FIRST = f"""{sql.PAIRS}, e AS (SELECT conv_id, turn, s.n AS side, CASE s.n WHEN 0 THEN h ELSE m END AS ws FROM pairs, (VALUES (0), (1)) s(n) WHERE len(h) >= 12 AND len(m) >= 12),
p AS (SELECT conv_id, turn, side, list_slice(ws, floor((len(ws) - 12) * 0.5)::INT + 1, floor((len(ws) - 12) * 0.5)::INT + 12) AS c FROM e),
t AS (SELECT conv_id, turn, side, i, c[i] AS form FROM (SELECT *, unnest(range(1, 13)) AS i FROM p))"""


@query(f"WITH {_FIRST}, k AS (SELECT *, {sql.key('form')} AS key, row_number() OVER (PARTITION BY {sql.key('form')} ORDER BY conv_id, turn, side, i) AS r FROM t) SELECT key, lower(form) AS lemma, form, {sql.upos('form')} AS upos FROM k WHERE r = 1")
def first_seen_forms(spark, sf):
    own = pairs(spark, sf).withColumn("turn", F.element_at(F.split("pair_id", "-"), -1).cast("long"))
    return prevalence.first_seen(own, ["conv_id", "turn"])


def _by_model(spark, sf):
    return prevalence.wlas(pairs(spark, sf), ("model",))


_BY_MODEL = f"{sql.PAIRS}, {sql.wlas(by='model')}"


@query(f"WITH {_BY_MODEL}, a AS (SELECT key, avg(ell_H) AS h, avg(ell_M) AS m, round_even(avg(n_pairs), 0)::INT AS n_pairs, count(*) AS n_models FROM t GROUP BY key) SELECT key, n_pairs, n_models, round(h, 9) AS ell_H, round(m, 9) AS ell_M, round(m - h, 9) AS LAS FROM a")
def las_macro(spark, sf):
    own = prevalence.macro(_by_model(spark, sf))
    return own.select("key", "n_pairs", "n_models", *(F.round(c, 9).alias(c) for c in ("ell_H", "ell_M", "LAS")))


@query(f"WITH {_BY_MODEL}, s AS (SELECT key, sum(c_H) AS c_H, sum(c_M) AS c_M, sum(n_pairs)::BIGINT AS n_pairs FROM t GROUP BY key), e AS (SELECT *, (c_H + 0.5) / (n_pairs + 1.0::DOUBLE) AS ell_H, (c_M + 0.5) / (n_pairs + 1.0::DOUBLE) AS ell_M FROM s) SELECT key, n_pairs, c_H, c_M, ell_H, ell_M, ell_M - ell_H AS LAS, (ell_M - ell_H) * 100 / greatest(ell_H, 1e-3::DOUBLE) AS relpct_MH FROM e")
def las_micro(spark, sf):
    return prevalence.micro(_by_model(spark, sf)).select("key", "n_pairs", "c_H", "c_M", "ell_H", "ell_M", "LAS", "relpct_MH")


_SCORED = f"""{sql.DISCOVERED}, {sql.LINES}, lw AS (SELECT doc_id, line_no, CASE WHEN token_count > 0 THEN {sql.words('text')} ELSE [NULL] END AS ws FROM lines),
lk AS (SELECT doc_id, line_no, unnest(ws) AS w FROM lw),
d AS (SELECT doc_id, line_no, w, coalesce(LAS, 0.0) AS d FROM (SELECT doc_id, line_no, w, {sql.key('w')} AS key FROM lk) LEFT JOIN ranked USING (key)),
l2 AS (SELECT doc_id, line_no, count(w) AS len_used, coalesce(sqrt(avg(CASE WHEN w IS NOT NULL THEN d * d END)), 0.0) AS s FROM d GROUP BY doc_id, line_no)"""


def _sentence_scores(spark, sf, p):
    return scoring.sentences(line_keys(spark, sf), scoring.deltas(discovered(spark, sf)), ["doc_id", "line_no"], p)


@query(f"WITH {_SCORED} SELECT doc_id, line_no, len_used, round(s, 9) AS sLAS FROM l2")
def score_sequences_l2(spark, sf):
    return _sentence_scores(spark, sf, 2.0).select("doc_id", "line_no", "len_used", F.round("sLAS", 9).alias("sLAS"))


@query(f"WITH {_SCORED} SELECT doc_id, line_no, count(w) AS len_used, round(coalesce(avg(CASE WHEN w IS NOT NULL THEN d END), 0.0), 9) + 0.0::DOUBLE AS sLAS FROM d GROUP BY doc_id, line_no")
def score_sequences_signed(spark, sf):
    return _sentence_scores(spark, sf, None).select("doc_id", "line_no", "len_used", F.round("sLAS", 9).alias("sLAS"))


@query(f"WITH {_SCORED} SELECT doc_id, round(avg(s), 9) AS dLAS, count(*) AS n_sentences FROM l2 GROUP BY doc_id")
def score_documents(spark, sf):
    return scoring.documents(_sentence_scores(spark, sf, 2.0), ["doc_id"]).select("doc_id", F.round("dLAS", 9).alias("dLAS"), "n_sentences")


@query(f"WITH {_SCORED} SELECT round(avg(dl), 9) AS mean_dLAS, count(*) AS n_docs FROM (SELECT avg(s) AS dl FROM l2 GROUP BY doc_id)")
def score_dataset(spark, sf):
    return scoring.dataset(scoring.documents(_sentence_scores(spark, sf, 2.0), ["doc_id"])).select(F.round("mean_dLAS", 9).alias("mean_dLAS"), "n_docs")


@query(f"WITH {sql.DISCOVERED} SELECT key, rank_LAS FROM ranked WHERE rank_LAS <= 50")
def top_ai_words(spark, sf):
    return selection.top_words(discovered(spark, sf), 50).select("key", "rank_LAS")


@query(f"WITH {sql.DISCOVERED} SELECT key, lpr_guard_ok FROM (SELECT *, row_number() OVER (ORDER BY count_ratio_MH DESC, key) AS n FROM ranked WHERE lpr_guard_ok = 1) WHERE n <= 20")
def top_ai_words_lpr(spark, sf):
    return selection.top_words(discovered(spark, sf), 20, "lpr").select("key", "lpr_guard_ok")


NEUTRAL_SQL = """near AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(LAS), key) AS n1 FROM ranked) WHERE n1 <= 2000),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c_H DESC, key) AS n2 FROM near) WHERE n2 <= 100),
neutral AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', key)), key) AS n3 FROM pool) WHERE n3 <= 50)"""


@query(f"WITH {sql.DISCOVERED}, {NEUTRAL_SQL} SELECT key, LAS FROM neutral")
def neutral_baseline(spark, sf):
    return selection.neutral(discovered(spark, sf), 50, 42).select("key", "LAS")


MATCHED_SQL = """chosen AS (SELECT key, upos FROM ranked WHERE rank_LAS <= 50), quota AS (SELECT upos, count(*) AS quota FROM chosen GROUP BY upos),
matched AS (SELECT key, upos FROM (SELECT r.key, r.upos, row_number() OVER (PARTITION BY r.upos ORDER BY abs(r.LAS), r.c_M DESC, r.key) AS n FROM ranked r WHERE r.key NOT IN (SELECT key FROM chosen)) JOIN quota USING (upos) WHERE n <= quota)"""


def tagged(spark, sf):
    return discovered(spark, sf).withColumn("upos", F.regexp_extract("key", "_([^_]*)$", 1))


@query(f"WITH {sql.DISCOVERED}, {MATCHED_SQL} SELECT key, upos FROM matched")
def upos_matched_baseline(spark, sf):
    own = tagged(spark, sf)
    return selection.matched_baseline(own, selection.top_words(own, 50)).select("key", "upos")


@query(f"WITH {sql.DISCOVERED} SELECT upos, count(*) AS count FROM ranked WHERE rank_LAS <= 50 GROUP BY upos")
def seed_upos(spark, sf):
    return selection.distribution(selection.top_words(tagged(spark, sf), 50))


_SIZES = (10, 12, 16, 24)


@query(f"WITH {sql.PAIRS}, " + ", ".join(sql.wlas(k=k, name=f"t{k}") for k in _SIZES) + " " + " UNION ALL ".join(f"SELECT {k} AS k, (SELECT any_value(n_pairs) FROM t{k}_n) AS n_pairs, count(*) AS unique_keys, count(*) FILTER (LAS > 0) AS n_positive FROM t{k}" for k in _SIZES))
def window_sweep(spark, sf):
    """One plan for all window sizes: the pairs are read once a size, no run by run."""
    out = prevalence.sweep(pairs(spark, sf), _SIZES).groupBy("k").agg(F.max("n_pairs").alias("n_pairs"), F.count("*").alias("unique_keys"), F.count_if(F.col("LAS") > 0).alias("n_positive"))
    return out.select("k", "n_pairs", "unique_keys", "n_positive")


def _two(spark, sf):
    own = pairs(spark, sf)
    return (prevalence.with_lpr(prevalence.wlas(own.where(F.pmod("conv_id", F.lit(2)) == n))) for n in (0, 1))


_TWO = f"{sql.PAIRS}, {sql.wlas(where='conv_id % 2 = 0', name='ta')}, {sql.wlas(where='conv_id % 2 = 1', name='tb')}"
_XY = f"{_TWO}, xy AS (SELECT key, CASE WHEN ta.c_M >= 3 THEN ln(ta.count_ratio_MH) END AS x, CASE WHEN tb.c_M >= 3 THEN ln(tb.count_ratio_MH) END AS y, ta.count_ratio_MH AS ra, tb.count_ratio_MH AS rb FROM ta JOIN tb USING (key) WHERE ta.c_M >= 3 AND tb.c_M >= 3)"


def _lpr_pairs(spark, sf):
    own = pairs(spark, sf)
    a, b = (prevalence.with_lpr(prevalence.wlas(own.where(F.pmod("conv_id", F.lit(2)) == n)), least=3.0) for n in (0, 1))
    return similarity.lpr_pairs(a, b)


@query(f"WITH {_XY} SELECT count(*) AS n, round({sql.pearson('x', 'y')}, 9) AS pearson FROM xy")
def lpr_similarity_pearson(spark, sf):
    return similarity.correlation(_lpr_pairs(spark, sf)).select("n", F.round("pearson", 9).alias("pearson"))


@query(f"WITH {_XY}, r AS (SELECT rank() OVER (ORDER BY ra) + (count(*) OVER (PARTITION BY ra) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY rb) + (count(*) OVER (PARTITION BY rb) - 1) / 2.0::DOUBLE AS ry FROM xy) SELECT round({sql.pearson('rx', 'ry')}, 9) AS spearman FROM r")
def lpr_similarity_spearman(spark, sf):
    return similarity.rank_correlation(_lpr_pairs(spark, sf)).select(F.round("spearman", 9).alias("spearman"))


@query(f"WITH {_XY} SELECT count(*) AS n, round(median(abs(x - y)), 9) AS median_abs_diff, round(avg(abs(x - y)), 9) AS mae, round(sqrt(avg((x - y) * (x - y))), 9) AS rmse, count(x - y) / count(*)::DOUBLE AS coverage FROM xy")
def lpr_similarity_errors(spark, sf):
    return similarity.errors(_lpr_pairs(spark, sf)).select("n", *(F.round(c, 9).alias(c) for c in ("median_abs_diff", "mae", "rmse")), "coverage")


@query(f"WITH {_XY} SELECT key, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT *, row_number() OVER (ORDER BY greatest(abs(x), abs(y)) DESC, key) AS n FROM xy) WHERE n <= 20")
def topk_similarity(spark, sf):
    return similarity.top_pairs(_lpr_pairs(spark, sf), 20).select("key", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {_TWO}, j AS (SELECT key, ta.c_M AS a, tb.c_M AS b FROM ta JOIN tb USING (key)), f AS (SELECT key, a / sum(a) OVER () AS x, b / sum(b) OVER () AS y, a + b AS s FROM j) SELECT count(*) AS n, round({sql.pearson('x', 'y')}, 9) AS pearson FROM f WHERE s >= 3")
def relfreq_corr(spark, sf):
    a, b = _two(spark, sf)
    return similarity.correlation(similarity.relative_frequencies(a, b, least=3)).select("n", F.round("pearson", 9).alias("pearson"))


@query(
    f"WITH {sql.DISCOVERED}, o AS (SELECT *, (c_M + 1) / (c_H + 1) AS r FROM ranked WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]')) SELECT regexp_extract(key, '^(.*)_[^_]*$', 1) AS w, upos AS u, round(LAS, 6) AS las, round(CASE WHEN c_M >= 20 THEN log2(r) ELSE 0.0 END, 4) AS lpr, round(c_M / (n_pairs * 12) * 1e6::DOUBLE, 1) AS a, round(c_H / (n_pairs * 12) * 1e6::DOUBLE, 1) AS h, round(r, 4) AS r, row_number() OVER (ORDER BY LAS DESC, key) AS rk_las, row_number() OVER (ORDER BY CASE WHEN c_M >= 20 THEN r ELSE 1.0 END DESC, key) AS rk_lpr FROM o"
)
def explorer_rows(spark, sf):
    return explorer.rows(discovered(spark, sf))


@query(f"WITH {_BY_MODEL} SELECT model, count(*) AS n_words, count(*) FILTER (LAS > 0) AS n_over, max(n_pairs) AS n_pairs FROM t GROUP BY model")
def explorer_index(spark, sf):
    return explorer.index(_by_model(spark, sf), ["model"])
