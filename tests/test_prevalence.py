import random

import pytest

from glossade.operators import prevalence, scoring, selection


def tokens(words):
    return [(w, w.lower(), "PUNCT" if w == "." else "WORD") for w in words]


def brute(pairs, k, windows, policy, exclude=()):
    """The definition, in plain Python."""
    count, n = {}, 0
    for h, m in pairs:
        if len(h) < k or len(m) < k:
            continue
        n += 1
        for side, w in (("h", h), ("m", m)):
            span = len(w) - k
            starts = {"first": [0], "last": [span]}.get(policy) or [min(span, max(0, int((i + 0.5) / windows * span))) for i in range(windows)]
            for s in starts:
                for key in {f"{lemma}_{u}" for _, lemma, u in w[s : s + k] if u not in exclude}:
                    c = count.setdefault(key, {"h": 0, "m": 0})
                    c[side] += 1 / len(starts)
    return n, count


@pytest.mark.parametrize("windows, policy, exclude", [(1, "quantile", ()), (3, "quantile", ("PUNCT",)), (1, "first", ()), (1, "last", ())])
def test_wlas_is_the_definition(spark, windows, policy, exclude):
    rng = random.Random(5)
    words = [*"abcdefg.", "The"]
    rows = [(tokens(rng.choices(words, k=rng.randint(0, 30))), tokens(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(60)]
    tok = "array<struct<form:string,lemma:string,upos:string>>"
    df = spark.createDataFrame([(str(i), h, m) for i, (h, m) in enumerate(rows)], f"pair_id string, h {tok}, m {tok}")
    n, want = brute(rows, 8, windows, policy, exclude)
    got = prevalence.ranked(prevalence.with_lpr(prevalence.wlas(df, k=8, windows=windows, policy=policy, exclude=exclude))).collect()
    assert {r.key for r in got} == {*want}
    for r in got:
        assert r.n_pairs == n
        assert r.c_H == pytest.approx(want[r.key]["h"]) and r.c_M == pytest.approx(want[r.key]["m"])
        assert 0 < r.ell_H < 1 and 0 < r.ell_M < 1
    assert sorted(r.rank_LAS for r in got) == [*range(1, len(got) + 1)]
    swapped = {r.key: r.LAS for r in prevalence.wlas(df.selectExpr("pair_id", "m as h", "h as m"), k=8, windows=windows, policy=policy, exclude=exclude).collect()}
    assert all(swapped[r.key] == pytest.approx(-r.LAS) for r in got)


def test_scores(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, None)], "s int, key string")
    delta = spark.createDataFrame([("a", 0.3), ("b", -0.4)], "key string, delta double")
    got = {r.s: r for r in scoring.sentences(keys, delta, ["s"]).collect()}
    assert got[1].sLAS == pytest.approx(0.28867513459481287) and (got[2].sLAS, got[2].len_used) == (0.0, 0)
    assert {r.s: r.sLAS for r in scoring.sentences(keys, delta, ["s"], None).collect()}[1] == pytest.approx(-0.03333333333333335)


def test_sampling_repeats(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as g")
    a = [r.id for r in selection.sample_per(df, ["g"], 5, 1, "id").orderBy("id").collect()]
    assert a == [r.id for r in selection.sample_per(df.repartition(7), ["g"], 5, 1, "id").orderBy("id").collect()] and len(a) == 15
    assert a != [r.id for r in selection.sample_per(df, ["g"], 5, 2, "id").orderBy("id").collect()]


def test_a_common_key_is_dealt_to_many_tasks(spark, monkeypatch):
    """Scores of tokens that share one key are right; its tokens stay where they are if the table is small, and else meet its difference in many tasks."""
    from glossade.operators import scoring

    keys = spark.range(6400).selectExpr("id AS line_no", "IF(id % 100 = 0, NULL, IF(id % 64 = 1, 'rare', 'the')) AS key")
    delta = spark.createDataFrame([("the", 0.25)], "key string, delta double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, v in zip(("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"), ("-1", "false", "64")):
            spark.conf.set(f"spark.sql.{k}", v)
        each = lambda: {r.line_no: (r.len_used, r.sLAS) for r in scoring.sentences(keys, delta, ["line_no"]).collect()}
        assert "BroadcastHashJoin" in scoring.met(keys, delta, ["line_no"])._jdf.queryExecution().executedPlan().toString()
        small = each()
        monkeypatch.setattr(scoring, "KEYS", 0)
        tasks = scoring.met(keys, delta, ["line_no"]).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(tasks) == 6400 and max(tasks) < 1600
        got = each()
    finally:
        for k, v in zip(("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"), before):
            spark.conf.set(f"spark.sql.{k}", v)
    assert got == small == {i: (0, 0.0) if i % 100 == 0 else (1, 0.0 if i % 64 == 1 else 0.25) for i in range(6400)}
