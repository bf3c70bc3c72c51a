"""Tokens with a lemma and a part of speech, keys made of them, and the protocols for models that are not part of this library."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ASCII_SPACE, words


class Tagger(Protocol):
    """Tags a batch of texts: per text its sentences, each a list of tokens as (form, lemma, upos)."""

    def __call__(self, texts: list[str], lang: str) -> Iterable[list[list[tuple[str, str, str]]]]: ...


class Tokenizer(Protocol):
    def __call__(self, texts: list[str]) -> Iterable[int]:
        """Tokens of each text."""


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> Iterable[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[dict]) -> Iterable[dict]: ...


def rule_upos(form: Column) -> Column:
    """PUNCT without a letter or digit, NUM of digits alone, else WORD: a stand-in where no tagger is at hand."""
    return F.when(~form.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(form.rlike(r"^[0-9]+$"), "NUM").otherwise("WORD")


def rule_tokens(text: Column) -> Column:
    """White-space words as tokens: the lemma is the lower-cased form."""
    return F.transform(words(text, ASCII_SPACE), lambda w: F.struct(w.alias("form"), F.lower(w).alias("lemma"), rule_upos(w).alias("upos")))


def key(token: Column, kind: str = "lemma_pos", lower: bool = False) -> Column:
    """lemma_pos, lemma, form_pos or form; the part of speech is never lower-cased. A missing part counts as empty."""
    word = F.coalesce(token["lemma" if kind.startswith("lemma") else "form"], F.lit(""))
    word = F.lower(word) if lower else word
    if kind in ("lemma", "form"):
        return word
    if kind in ("lemma_pos", "form_pos"):
        return F.concat(word, F.lit("_"), F.coalesce(token["upos"], F.lit("")))
    raise ValueError(f"unknown key {kind}")


def fold_yo(text: Column) -> Column:
    """Cyrillic io as ie; different keys may become equal."""
    return F.translate(text, "ё", "е")


def count_key(token: Column) -> Column:
    return F.concat(fold_yo(F.lower(F.coalesce(token["lemma"], F.lit("")))), F.lit("_"), F.coalesce(token["upos"], F.lit("")))


def sentence_id(lang: Column, year: Column, line: Column, sentence: Column) -> Column:
    return F.format_string("%s-%s-L%s-s%s", lang, year.cast("string"), line.cast("string"), sentence.cast("string"))


def parsed_sentence_id(sid: Column) -> Column:
    """Struct (lang, year, doc_id, sent_idx) of <lang>-<year>-L<line>-s<n>; all null under four parts, a bad number alone null."""
    p = F.split(sid, "-", -1)
    ok = F.size(p) >= 4
    return F.struct(
        F.when(ok, p[0]).alias("lang"),
        F.when(ok, p[1].try_cast("int")).alias("year"),
        F.when(ok, p[2]).alias("doc_id"),
        F.when(ok & p[3].startswith("s"), F.substring(p[3], 2, 1 << 30).try_cast("int")).alias("sent_idx"),
    )


# The English stop words.
STOPWORDS_EN = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the
    and but if or because as until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now ll re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
    shan shouldn wasn weren won wouldn
    """.split()
)


def is_stopword(lemma: Column, form: Column, stopwords=STOPWORDS_EN) -> Column:
    return F.lower(F.coalesce(F.nullif(lemma, F.lit("")), form)).isin(*sorted(stopwords))
