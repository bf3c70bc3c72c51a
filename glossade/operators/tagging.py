"""Tagging of lines and of generated texts by an injected Tagger; embeddings by an injected Embedder, computed once a word."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_space
from ..functions.tokens import Embedder, Tagger

TOKENS = "array<struct<form:string,lemma:string,upos:string>>"
LONGEST = 20_000
_SOLID = re.compile(r"\S+")


def rule_tagger(texts: list[str], lang: str) -> Iterable[list[list[tuple[str, str, str]]]]:
    """A stand-in Tagger: white-space words, one sentence a text; the lemma is the lower-cased form."""

    def tag(w: str) -> tuple[str, str, str]:
        return w, w.lower(), "PUNCT" if not any(map(str.isalnum, w)) else "NUM" if w.isascii() and w.isdigit() else "WORD"

    return [[[tag(w) for w in _SOLID.findall(t)]] for t in texts]


def _tagged(tagger: Tagger, texts: list[str], lang: str) -> list[tuple[list | None, str | None]]:
    """(sentences, error) a text: the batch at once, or where that fails each text alone, so that one bad text spoils no other."""
    if not texts:
        return []
    try:
        got = [*tagger(texts, lang)]
        if len(got) == len(texts):
            return [(s, None) for s in got]
    except Exception:  # noqa: BLE001  told apart below, text by text
        pass
    out: list[tuple[list | None, str | None]] = []
    for t in texts:
        try:
            out.append((next(iter(tagger([t], lang))), None))
        except Exception as e:  # noqa: BLE001  it goes to the error column
            out.append((None, f"{type(e).__name__}: {e}"))
    return out


def tag_lines(lines: DataFrame, tagger: Tagger, longest: int = LONGEST, batch: int = 256) -> DataFrame:
    """lines (lang, year, line_no, text) as sentences (lang, year, line_no, sent_no, sent_id, text, tokens, error).

    Blank lines are left out. A line that is too long (error too_long) or that the tagger fails on has one row without tokens; bad_lines() and
    sentences are told apart by error. The text of a sentence is its line's where the line is one sentence, else its forms joined.
    """
    own = lines.select("lang", F.col("year").cast("string").alias("year"), F.col("line_no").cast("long").alias("line_no"), strip_space(F.col("text")).alias("text")).where("text != ''")

    def run(batches):
        for pdf in batches:
            for (lang,), part in pdf.groupby(["lang"], sort=False, dropna=False):
                lang = lang if isinstance(lang, str) else ""
                for at in range(0, len(part), batch):
                    rows = [*part.iloc[at : at + batch].itertuples(index=False)]
                    short = [r for r in rows if len(r.text) <= longest]
                    out = [(r.lang, r.year, r.line_no, None, None, r.text, None, "too_long") for r in rows if len(r.text) > longest]
                    for r, (sentences, error) in zip(short, _tagged(tagger, [r.text for r in short], lang)):
                        if error:
                            out.append((r.lang, r.year, r.line_no, None, None, r.text, None, error))
                        for n, s in enumerate(sentences or (), 1):
                            said = r.text if len(sentences) == 1 else " ".join(f for f, _, _ in s)
                            out.append((r.lang, r.year, r.line_no, n, f"{lang}-{r.year}-L{r.line_no}-s{n}", said, [{"form": f, "lemma": le, "upos": u} for f, le, u in s], None))
                    if out:
                        yield pd.DataFrame(out, columns=["lang", "year", "line_no", "sent_no", "sent_id", "text", "tokens", "error"]).astype({"sent_no": "Int64"})

    return own.mapInPandas(run, f"lang string, year string, line_no long, sent_no long, sent_id string, text string, tokens {TOKENS}, error string")


def bad_lines(tagged: DataFrame) -> DataFrame:
    """(lang, year, line_no, text_len, error) of what was not tagged."""
    return tagged.where("error is not null").select("lang", "year", "line_no", F.length("text").alias("text_len"), "error")


def progress(tagged: DataFrame) -> DataFrame:
    """(lang, year, lines, sentences, tokens, bytes, failed): what a run has done, by file."""
    own = tagged.groupBy("lang", "year", "line_no").agg(F.count("tokens").alias("s"), F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("t"), F.max(F.octet_length("text")).alias("b"), F.max(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("f"))
    return own.groupBy("lang", "year").agg(F.count("*").alias("lines"), F.sum("s").alias("sentences"), F.sum("t").alias("tokens"), F.sum("b").alias("bytes"), F.sum("f").alias("failed"))


def tag_continuations(records: DataFrame, tagger: Tagger, longest: int = LONGEST, batch: int = 32) -> DataFrame:
    """records (lang, output.ai_continuation and more) with parse_ai, an array of (lemma, pos): empty for blank, over-long and failed texts; no row is lost."""
    cols = [c for c in records.columns if c != "parse_ai"]
    parsed = "array<struct<lemma:string,pos:string>>"

    @F.pandas_udf(parsed)
    def tag(text: pd.Series, lang: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in text]
        texts, langs = [t.strip() if isinstance(t, str) else "" for t in text], [x if isinstance(x, str) else "" for x in lang]
        for own in dict.fromkeys(langs):
            at = [i for i, t in enumerate(texts) if langs[i] == own and t and len(t) <= longest]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, (sentences, _) in zip(part, _tagged(tagger, [texts[i] for i in part], own)):
                    out[i] = [{"lemma": le, "pos": u} for s in sentences or () for _, le, u in s]
        return pd.Series(out)

    return records.select(*cols, tag(F.col("output.ai_continuation"), F.col("lang")).alias("parse_ai"))


def with_embeddings(words: DataFrame, embedder: Embedder, store: str) -> DataFrame:
    """(lang, lemma, embedding) of words (lang, lemma): what the table at store has is read from it, the rest is computed and appended there.

    Words are told by language and lemma, not by place, so the table stays right when a list changes.
    """
    from ..sources.outputs import exists

    spark = words.sparkSession
    schema = "lang string, lemma string, embedding array<float>"
    own = words.select("lang", "lemma").distinct()
    new = own.join(spark.read.schema(schema).parquet(store), ["lang", "lemma"], "left_anti") if exists(spark, store) else own

    def run(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[[float(x) for x in v] for v in embedder(pdf["lemma"].tolist())])

    new.mapInPandas(run, schema).write.mode("append").parquet(store)
    return own.join(spark.read.schema(schema).parquet(store), ["lang", "lemma"])
