import math
import os

import pytest
from pyspark.sql import functions as F

from glossade.functions import stats as S
from glossade.operators import counts, generation, prevalence


def test_chi2(spark):
    df = spark.createDataFrame([(10, 990, 30, 970), (100, 99900, 180, 99820), (0, 10, 0, 10)], "a long, b long, c long, d long")
    got = df.select(S.yates_chi2(*(F.col(c) for c in "abcd")).alias("x")).withColumn("p", S.chi2_p(F.col("x"))).collect()
    assert got[0].x == pytest.approx(9.209183673469388, rel=1e-14) and got[0].p == pytest.approx(0.002408040467287956, rel=1e-9)
    assert got[1].x == pytest.approx(22.32053446253326) and got[1].p == pytest.approx(2.307e-06, rel=1e-3)
    assert got[2].x is None and got[2].p == 1.0


def test_p_is_erfc(spark):
    xs = [0.01, 0.5, 3.84, 7.99, 8.01, 10.83, 50.0, 300.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", S.chi2_p(F.col("x"))).collect():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-9)


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (2.0, 2.0, 5.0), (3.0, 3.0, 5.0)], "a double, b double, c double")
    assert S.spearman(df, "a", "b").first().spearman == pytest.approx(1.0)
    assert S.spearman(df, "a", "c").first().spearman is None
    assert df.limit(1).agg(S.pearson(F.col("a"), F.col("b"))).first()[0] is None


def test_prevalence_numbers(spark):
    df = spark.createDataFrame([("k", 100, 0.0, 20.0), ("l", 100, 0.0, 19.0)], "key string, n_pairs int, c_H double, c_M double")
    k, l = prevalence.with_lpr(prevalence.differences(df)).orderBy("key").collect()
    assert k.ell_H == 0.0049504950495049506 and k.ell_M == 0.20297029702970298 and k.LAS == pytest.approx(0.19801980198019803)
    assert k.lpr_MH == pytest.approx(3.713572066704308) and k.lpr_guard_ok == 1
    assert (l.lpr_guard_ok, l.lpr_MH_guarded) == (0, 0.0)
    with pytest.raises(ValueError):
        prevalence.with_lpr(df, alpha=0)


@pytest.mark.parametrize("span, m, policy, want", [(18, 1, "quantile", [9]), (8, 3, "quantile", [1, 4, 6]), (0, 3, "quantile", [0, 0, 0]), (18, 1, "first", [0]), (18, 1, "last", [18])])
def test_window_starts(spark, span, m, policy, want):
    assert spark.range(1).select(prevalence.starts(F.lit(span), m, policy).alias("s")).first().s == want


def test_token_budget(spark):
    df = spark.createDataFrame([(12,), (29,), (59,), (0,)], "n int")
    low, high = generation.budget(F.col("n"), F.lit(1.1047))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(7, 20), (17, 49), (23, 98), (1, 2)]


def test_opm_skips_missing_periods(spark):
    c = spark.createDataFrame([("k", "2020", 4), ("k", "2023", 8), ("j", "2020", 6), ("j", "2023", 2)], "key string, period string, count long")
    got = {r.key: r for r in counts.opm_table(c, counts.totals(c, ["period"]), "period", ["2020", "2021"], ["2023"], ["key"]).collect()}
    assert got["k"].opm_pre == pytest.approx(400_000) and got["k"].opm_2021 is None
    assert got["k"].pct_change == pytest.approx(100)


def test_macro_is_not_zero_filled(spark):
    t = spark.createDataFrame([("k", 10, 0.2, 0.4)], "key string, n_pairs int, ell_H double, ell_M double")
    r = prevalence.macro(t).first()
    assert (r.ell_H, r.ell_M, r.n_models) == (0.2, 0.4, 1)


def test_numbered_is_a_row_number(spark):
    """Places by value and key, however many share a value or the first characters of their keys."""
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice([0.5, 0.25, -1.0, rng.random()]), "".join(rng.choices("abé😀", k=rng.randint(0, 5))) + str(i)) for i in range(400)]
    got = {r.id: r.place for r in S.numbered(spark.createDataFrame(rows, "id int, v double, key string"), "place", F.col("v")).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2].encode()))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}
    assert S.numbered(spark.createDataFrame([], "id int, v double, key string"), "place", F.col("v")).count() == 0


def test_average_ranks_by_group(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), (None, 2.0), (None, 1.0), (None, 2.0), (None, 2.0)]
    got = S.with_average_rank(spark.createDataFrame(rows, "g string, x double"), "r", "x", "g").collect()
    assert sorted((r.g or "", r.x, r.r) for r in got) == [("", 1.0, 1.0), ("", 2.0, 3.0), ("", 2.0, 3.0), ("", 2.0, 3.0), ("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 3.0, 3.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_share_p_values_are_the_definition(spark):
    from glossade.plans import shift

    got = shift.share_p_values(spark, "/root/testdata/sf0.001").collect()
    assert got
    for r in got:
        assert r.p_value == pytest.approx(math.erfc(math.sqrt((r.chi2 or 0) / 2)), rel=1e-9) and r.significant == (r.p_value < 0.001)


def test_word_totals_are_those_of_the_keys(spark, tmp_path):
    """Totals come from the numbers of words, without an explode; null, blank and empty texts count nothing."""
    from pyspark.sql import functions as F

    from glossade.operators import counts
    from glossade.plans import inputs

    rows = [("a", "one two  two\n"), ("a", None), ("b", " \t"), ("b", ""), ("c", "Ё 7 ...")]
    spark.createDataFrame(rows, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = inputs.word_totals(spark, str(tmp_path), period=F.col("source"))
    want = counts.totals(inputs.key_counts(spark, str(tmp_path), period=F.col("source")), ["period"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("a", 3), ("c", 3)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
