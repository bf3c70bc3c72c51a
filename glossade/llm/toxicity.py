"""Operator 7: toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Terms that labels mark as toxic in many different contexts make the lexicon, kept as a trie. A word of a text that is no
term is run as a bit-parallel Levenshtein automaton along the trie, so misspelled terms are caught. Each hit is judged by
its context window: inside quotation marks or after a reporting word it counts as quotation, otherwise as abuse. A logistic model
over these counts gives the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, sampled, split_of, texts, written

WORD = re.compile(r"[^\W\d_]+")
#: Bound of the fit: labelled rows, each as a whole.
SAMPLE_ROWS = 8000
#: A term needs so many different contexts in toxic rows of the sample, such odds, and such a log-likelihood ratio (G squared): a rare word of a
#: few toxic rows, or of copies of one, is no term. All words that pass are terms.
CONTEXTS, ODDS, EVIDENCE = 3, 8.0, 25.0
#: Characters on each side of a hit that are looked at.
SIDE = 80
OPEN, CLOSE = "“„«‹", "”»›"
REPORTS = re.compile(r"\b(?:said|says|wrote|writes|quot\w*|called|term|word|cit\w*|dijo|dice|palabra|dit|mot|sagte|wort|zitat)\b")
FEATURES = ("exact_direct", "fuzzy_direct", "exact_quoted", "fuzzy_quoted", "different", "density")


def edits(term: str) -> int:
    """Edits allowed for a term by its length: short ones have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """The lexicon; each node knows the most edits that a term below it allows."""

    def __init__(self, terms):
        self.terms = sorted(set(terms))
        self.known = set(self.terms)
        self.root: dict = {}
        for t in self.terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        # of k + 1 parts of a term, a word within k edits holds one unchanged: the first at its start, the last at its end, the middle at most one place off
        self.first: dict[str, set[int]] = {}
        self.last: dict[str, set[int]] = {}
        self.middle: dict[str, set[tuple[int, int]]] = {}
        for t in self.terms:
            if not (k := edits(t)):
                continue
            n, sizes = len(t), range(len(t) - k, len(t) + k + 1)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            self.first.setdefault(t[: cuts[1]], set()).update(sizes)
            self.last.setdefault(t[cuts[-2] :], set()).update(sizes)
            if k == 2:
                self.middle.setdefault(t[cuts[1] : cuts[2]], set()).update((cuts[1] + off, size) for off in (-1, 0, 1) for size in sizes)
        self.sizes = [sorted({len(x) for x in of}) for of in (self.first, self.last)]
        self.spots = sorted({(at, len(x)) for x, of in self.middle.items() for at, _ in of})

    def near(self, word: str) -> bool:
        """Whether word may be within its edits of some term: a quick test that no such word fails."""
        n = len(word)
        for size in self.sizes[0]:
            if (of := self.first.get(word[:size])) and n in of:
                return True
        for size in self.sizes[1]:
            if (of := self.last.get(word[-size:])) and n in of:
                return True
        return any((of := self.middle.get(word[at : at + size])) and (at, n) in of for at, size in self.spots)

    def match(self, word: str) -> str | None:
        """The term nearest to word within its edits (exact first, then fewer edits, then by name), or None."""
        if word in self.known:
            return word
        if not self.near(word):
            return None
        n, most = len(word), 2
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        start = tuple((1 << e + 1) - 1 for e in range(most + 1))  # with e edits, up to e characters of the word may be skipped
        full, best = (1 << n + 1) - 1, None
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e in range(edits(child) + 1):
                        if states[e] >> n & 1:
                            if best is None or (e, child) < best:
                                best = (e, child)
                            break
                    continue
                m, new = mask.get(c, 0), []
                for e, s in enumerate(states):
                    x = (s & m) << 1
                    if e:
                        before = states[e - 1]
                        x |= before | before << 1 | new[e - 1] << 1
                    new.append(x & full)
                if new[most]:
                    stack.append((child, tuple(new)))
        return best[1] if best else None


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the context window shows the hit as quotation: an open quotation mark before it in its line, or a reporting word."""
    left = text[max(0, start - SIDE) : start].rpartition("\n")[2]
    right = text[end : end + SIDE].partition("\n")[0]
    if left.count('"') % 2 and '"' in right:
        return True
    opened = max(map(left.rfind, OPEN))
    if opened >= 0 and opened > max(map(left.rfind, CLOSE)) and any(c in right for c in CLOSE):
        return True
    return bool(REPORTS.search(left[-SIDE // 2 :].lower()))


class Hits:
    """Finds a lexicon's terms in texts, remembering what words of a piece match."""

    def __init__(self, terms):
        self.trie = Trie(terms)

    def features(self, values: list[str]) -> np.ndarray:
        """A row of FEATURES a text, as log1p of counts."""
        low = [v.lower() for v in values]
        # lower-casing may change the length of a text; its words are then looked up in the lower-cased text
        found = [WORD.findall(v) for v in low]
        memo = {w: t for w in set().union(*map(set, found)) if (t := self.trie.match(w))}
        out = np.zeros((len(values), len(FEATURES)))
        for row, text, words in zip(out, low, found):
            if memo.keys().isdisjoint(words):
                continue
            terms = set()
            for m in WORD.finditer(text):
                if t := memo.get(m[0]):
                    terms.add(t)
                    row[2 * quoted(text, m.start(), m.end()) + (t != m[0])] += 1
            direct = row[0] + row[1]
            row[4], row[5] = len(terms), 100 * direct / len(words)
        return np.log1p(out)


class Model:
    def __init__(self, terms: list[str], weights: np.ndarray):
        self.hits, self.weights = Hits(terms), weights

    def scores(self, values: list[str]) -> np.ndarray:
        x = self.hits.features(values)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge on the weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labels of about `rows` doc_ids that are not held out, drawn by a hash of doc_id; of several texts of a doc_id the greatest."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (split_of() != 0))
    chosen = [tuple(r) for r in sampled(own, rows).distinct().collect()]
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int")
    labelled = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", "text", "toxic")
    labelled = written(labelled, "labelled")

    def contexts(batches):
        for b in batches:
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = WORD.findall(text.lower())
                seen = {}
                for left, w, right in zip(["", *words], words, [*words[1:], ""]):
                    if len(w) > 2:
                        seen.setdefault(w, f"{left} {right}")
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(seen.values()), pa.array([toxic] * len(seen), pa.int32())], names=["word", "context", "toxic"])

    total = Counter(dict(labelled.groupBy("toxic").count().collect()))
    if not total[1] or not total[0]:
        return Model([], np.array([0.0] * len(FEATURES) + [np.log((total[1] + 0.5) / (total[0] + 1.5))]))
    by = labelled.mapInArrow(contexts, "word string, context string, toxic int").groupBy("word").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("bad"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("context"))).alias("fine"))
    odds = (F.col("bad") + 0.5) / (total[1] + 1) / ((F.col("fine") + 0.5) / (total[0] + 1))
    share = (F.col("bad") + F.col("fine")) / float(total[1] + total[0])
    g2 = 2 * (F.col("bad") * F.ln(F.greatest("bad", F.lit(1)) / (share * total[1])) + F.col("fine") * F.ln(F.greatest("fine", F.lit(1)) / (share * total[0])))
    terms = [r.word for r in by.where((F.col("bad") >= CONTEXTS) & (odds >= ODDS) & (g2 >= EVIDENCE)).select("word").orderBy("word").collect()]
    shared = spark.sparkContext.broadcast(terms)

    def features(batches):
        hits = Hits(shared.value)
        for b in batches:
            x = hits.features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c) for c in x.T)], names=["doc_id", "toxic", *FEATURES])

    got = labelled.mapInArrow(features, "doc_id long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["doc_id", "toxic", *FEATURES])
    return Model(terms, logistic(got[[*FEATURES]].to_numpy(float), got["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, one row a row of docs; only the text is an input of a score.

    A null or empty text, like any without a hit, gets the score of no hits. Without labels of both kinds the score is the smoothed share of
    toxic rows. A null doc_id stays null and is not held out; rows that repeat stay. No shuffle: the lexicon comes from the fit's sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.hits.trie.terms, model.weights))
    held: list[Model] = []

    def run(batch: pa.RecordBatch, values: list[str]):
        if not held:
            held.append(Model(*shared.value))
        s = held[0].scores(values)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_texts(texts(docs).withColumn("held_out", F.coalesce(split_of() == 0, F.lit(False))), run, "doc_id long, held_out boolean, score double, predicted int")
