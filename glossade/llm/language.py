"""Operator 10: language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to character n-grams: at each of its
places the longest known n-gram that ends there, from four characters down to one, each level discounted (stupid backoff),
and the mean over the places. The model is fitted on a bounded sample of labelled rows, with all their words and n-grams;
every text is scored as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_pieces, map_texts, sampled, split_of, texts, unused, written

WORD = re.compile(r"[^\W\d_]+")
#: The sample's bound: labelled rows that are fitted on, each as a whole.
SAMPLE_ROWS = 4000
#: Occurrences in the sample that make a word, and an n-gram of two characters or more, known.
WORD_COUNT, GRAM_COUNT = 2, 3
LONGEST = 4
DISCOUNT = math.log(0.4)
#: Cells of text by language that are scored at once.
CELLS = 1 << 20


def letters(text: str) -> list[str]:
    """The runs of letters (category L) of a text, lower-cased; numbers that are no digits, like fractions, are no letters."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for is_letter, run in groupby(w, str.isalpha) if is_letter]


def grams_of(word: str) -> list[str]:
    """All n-grams of a word; ^ and $ are its ends."""
    s = f"^{word}$"
    return [s[j : j + n] for n in range(1, LONGEST + 1) for j in range(len(s) - n + 1)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + size[i] - 1 of every i, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Model:
    """Log frequencies by language, kept sparse: what a language has not seen scores its floor, the rest is stored as what lies above the floor.

    floors: a row for words, then one for n-grams of each length, each a value a language. A word or n-gram is a row of (language, value) pairs.
    """

    def __init__(self, langs: list[str], words: list[str], grams: list[str], floors: np.ndarray, ends: np.ndarray, lang: np.ndarray, value: np.ndarray):
        self.langs, self.floors, self.ends, self.lang, self.value = langs, floors, ends, lang, value
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: len(words) + i for i, g in enumerate(grams)}
        self.length = np.array([0] * len(words) + [len(g) for g in grams], dtype=np.int64)

    def state(self) -> tuple:
        return self.langs, [*self.words], [*self.grams], self.floors, self.ends, self.lang, self.value

    @classmethod
    def fit(cls, totals: dict[str, int], words: dict[tuple[str, str], int], mass: dict[tuple[int, str], int], grams: dict[tuple[str, str], int]) -> Model:
        """totals: words by language; words: counts of known words by (word, language); mass: n-grams by (length, language); grams: counts by (n-gram, language)."""
        langs = sorted(totals)
        at = {k: i for i, k in enumerate(langs)}
        total = np.array([totals[k] for k in langs], dtype=float) + 1.0
        size = np.array([[mass.get((n, k), 0) for k in langs] for n in range(1, LONGEST + 1)], dtype=float).reshape(LONGEST, len(langs)) + 1.0
        discount = DISCOUNT * (LONGEST - np.arange(1, LONGEST + 1))
        floors = np.vstack([np.log(0.5 / total)[None], np.log(0.5 / size) + discount[:, None]])
        names, counts = [[], []], []
        for of, known in ((words, names[0]), (grams, names[1])):
            last = None
            for (x, k), n in sorted(of.items()):
                if x != last:
                    known.append(x)
                    counts.append([])
                    last = x
                counts[-1].append((at[k], math.log((n + 0.5) / 0.5)))
        ends = np.cumsum([0, *map(len, counts)])
        flat = [x for c in counts for x in c]
        return cls(langs, *names, floors, ends, np.array([i for i, _ in flat], dtype=np.int32), np.array([v for _, v in flat], dtype=np.float64))

    def _places(self, word: str) -> list[int]:
        """The row of the longest known n-gram that ends at each place of an unseen word."""
        s, of, out = f"^{word}$", self.grams, []
        for end in range(2, len(s) + 1):
            for start in range(max(0, end - LONGEST), end):
                if (row := of.get(s[start:end])) is not None:
                    out.append(row)
                    break
        return out

    def _backed(self, unseen: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words that are not known: floors (a weight for each row of floors), and ends, languages and values as of known ones."""
        places = [self._places(w) for w in unseen]
        n = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        rows = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=int(n.sum()))
        which, weight = np.repeat(np.arange(len(unseen)), n), np.repeat(1 / np.maximum(n, 1), n)
        levels = np.bincount(which * (LONGEST + 1) + self.length[rows], weight, minlength=len(unseen) * (LONGEST + 1)).reshape(-1, LONGEST + 1)
        size = self.ends[rows + 1] - self.ends[rows]
        flat = _ranges(self.ends[rows], size)
        key, back = np.unique(np.repeat(which, size) * len(self.langs) + self.lang[flat], return_inverse=True)
        value = np.bincount(back, self.value[flat] * np.repeat(weight, size), minlength=len(key))
        ends = np.searchsorted(key, np.arange(len(unseen) + 1) * len(self.langs))
        return levels, ends, (key % len(self.langs)).astype(np.int32), value

    def predict(self, values: list[str]) -> list[tuple[str, float]]:
        """Language and posterior of each text; und and 0 for a text without a letter, and for all where nothing was learned."""
        if not self.langs:
            return [("und", 0.0) for _ in values]
        found = [letters(v) for v in values]
        step = max(1, CELLS // len(self.langs))
        return [x for k in range(0, len(found), step) for x in self._predict(found[k : k + step])]

    def _predict(self, found: list[list[str]]) -> list[tuple[str, float]]:
        n_langs, n_known, at = len(self.langs), len(self.words), self.words
        unseen = [*set(chain.from_iterable(found)).difference(at)]
        levels, ends, lang, value = self._backed(unseen)
        at = at | {w: n_known + i for i, w in enumerate(unseen)}
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(map(at.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(size.sum()))
        text = np.repeat(np.arange(len(found)), size)
        is_new = ids >= n_known
        score = np.zeros((len(found), n_langs))
        weight = np.zeros((len(found), LONGEST + 1))
        weight[:, 0] = np.bincount(text[~is_new], minlength=len(found))
        for of, rows, who, stops, lg, val in ((~is_new, ids[~is_new], text[~is_new], self.ends, self.lang, self.value), (is_new, ids[is_new] - n_known, text[is_new], ends, lang, value)):
            n = stops[rows + 1] - stops[rows]
            flat = _ranges(stops[rows], n)
            score += np.bincount(np.repeat(who, n) * n_langs + lg[flat], val[flat], minlength=score.size).reshape(score.shape)
        for k in range(1, LONGEST + 1):
            weight[:, k] = np.bincount(text[is_new], levels[ids[is_new] - n_known, k], minlength=len(found))
        score += weight @ self.floors
        best = score.argmax(axis=1)
        top = score[np.arange(len(found)), best]
        share = 1 / np.exp(np.clip(score - top[:, None], -700, 0)).sum(axis=1)
        return [(self.langs[b], s) if n else ("und", 0.0) for b, s, n in zip(best.tolist(), share.tolist(), size.tolist())]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows of about `rows` doc_ids that are not held out, drawn by a hash of doc_id; of several rows of a doc_id the greatest.

    Words and n-grams are counted by the executors; the driver gets those that occur often enough to be known, by language.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = sampled(own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (split_of() != 0)), rows)
    sample = own.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("x")).select("x.lang", "x.text")

    def split(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = letters(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string())], names=["lang", "word"])

    def cut(batches):
        for b in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for lang, w, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = by[lang]
                for g in grams_of(w):
                    own[g] += n
            for lang, own in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([*own], pa.string()), pa.array([*own.values()], pa.int64())], names=["lang", "gram", "n"])

    counted = written(sample.mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    dealt = counted.select("lang", "word", "n").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    grams = written(dealt.mapInArrow(cut, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    often = lambda df, of, least: df.join(df.groupBy(of).agg(F.sum("n").alias("every")).where(least), of, "left_semi").select(of, "lang", "n")
    pairs = lambda df: {(a, b): n for a, b, n in zip(*(c.to_pylist() for c in df.toArrow().columns))}
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    mass = pairs(grams.groupBy(F.length("gram").alias("k"), "lang").agg(F.sum("n").alias("n")))
    known = pairs(often(counted, "word", F.col("every") >= WORD_COUNT))
    return Model.fit(totals, known, mass, pairs(often(grams, "gram", (F.col("every") >= GRAM_COUNT) | (F.length("gram") == 1))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the prediction), one row a row of docs; only the text is an input of a prediction.

    `und` with score 0 where the text is null, empty or without a letter, and for every row where nothing was labelled. Ties go to the first
    language by name. A null doc_id stays null and is not held out; repeated rows stay. No shuffle: the model's size is bounded by its parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    held: list[Model] = []

    def run(batch: pa.RecordBatch, values: list[str]):
        if not held:
            held.append(Model(*shared.value))
        got = held[0].predict(values)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_texts(texts(docs).withColumn("held_out", F.coalesce(split_of() == 0, F.lit(False))), run, "doc_id long, held_out boolean, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the columns pred and score after its own, which must not have such names; otherwise as identify(). Only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    held: list[Model] = []

    @F.pandas_udf("lang string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Model(*shared.value))
        return pd.DataFrame([x for values in in_pieces(text) for x in held[0].predict(values)], columns=["lang", "score"])

    own, told = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "told")
    said = predict.asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit("")))  # so that no filter above runs it again
    return docs.select(*own, said.alias(told)).select(*own, F.col(f"{told}.lang").alias(pred), F.col(f"{told}.score").alias(score))
