import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossade.functions import text as T
from glossade.functions import tokens as K


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value, want",
    [("a b\tc\n d", "a b c d"), ("a‌b\r", "ab"), ("“x” «y» ‘z’…", "\"x\" \"y\" 'z'..."), ("  ", "")],
)
def test_basic_clean(spark, value, want):
    assert one(spark, value, T.basic_clean) == want


def test_cleaned_record(spark):
    def flags(value):
        return spark.createDataFrame([(value,)], "x string").select(*(c.alias(k) for k, c in T.cleaned(F.col("x")).items())).first()

    r = flags("12345 ab")
    assert (r.continuation, r.before_cleaning, r.cleaned) == ("", "12345 ab", 1)
    assert flags("word " * 20).review_repetition == 1
    assert flags("word " * 19).review_repetition == 0
    assert flags("hello <b>x</b>").review_markup == 1
    assert flags("!!! ?? a").review_punct_dominated == 1
    r = flags("plain text")
    assert (r.continuation, r.before_cleaning, r.cleaned, r.review_any) == ("plain text", "", 0, 0)
    assert flags(None).continuation == ""


def test_unicode_space_like_python(spark):
    s = "a\x1cb c  d"
    assert one(spark, s, T.words) == s.split()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=30), min_size=1, max_size=20))
def test_clean_is_idempotent(spark, values):
    df = spark.createDataFrame([(v.replace("\0", ""),) for v in values], "x string").select(T.basic_clean(F.col("x")).alias("a")).select("a", T.basic_clean(F.col("a")).alias("b"))
    for r in df.collect():
        assert r.a == r.b
        assert not any(unicodedata.category(c) == "Cc" for c in r.a)


def test_keys_and_ids(spark):
    df = spark.createDataFrame([(("Form", "Lemma", "NOUN"),), (("x", None, "PUNCT"),)], "t struct<form:string,lemma:string,upos:string>")
    assert [r.k for r in df.select(K.key(F.col("t"), "lemma_pos", True).alias("k")).collect()] == ["lemma_NOUN", "_PUNCT"]
    assert one(spark, "Ёлка", lambda c: K.fold_yo(F.lower(c))) == "елка"
    got = [one(spark, s, K.parsed_sentence_id) for s in ("en-2020-L115-s1", "en-x-L1-s1", "a-b")]
    assert [tuple(g) for g in got] == [("en", 2020, "L115", 1), ("en", None, "L1", 1), (None, None, None, None)]
    with pytest.raises(ValueError):
        K.key(F.col("t"), "other")
