"""Operator 6: benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

The test items are the indexed texts; every passage of every training text is a query. Document frequencies, the number of
items, their mean and greatest length are counted once over all items, so a score does not depend on which items share an
index. Impacts are divided by the item's own full score, so one threshold (a share of that score) holds for all items.

An index holds, for every term, its postings (item, impact) in order of items, cut to blocks of BLOCK neighbouring items
with the greatest impact of each. A passage is looked at only if it has an essential term (the others can't reach the
threshold together). Its weak AND, the sum of its terms' greatest impacts, is told for all blocks at once, where cursors
would go from pivot to pivot; only the postings of the blocks that reach the threshold are then read and summed by item.
Hits are verified by the overlap of the item's question and answer with the passage: the share of their word 5-grams found,
or of their words that need no edit to stand in the passage in order. Items without an answer column are
also found by the second as a whole.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_pieces, map_texts, texts, written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Items in a block; words of the items in an index: more are more indexes, each a pass over the corpus, with the same results.
BLOCK, INDEX_WORDS = 8, 1_000_000
#: Sums of passages by block that are held at once.
CELLS = 1 << 20
THRESHOLD, OVERLAP, GRAM = 0.6, 0.8, 5
#: Scores this near the threshold reach it, whatever the order in which they were summed.
SLACK = 1e-9
#: Share of an item's words, at its end, that count as the answer where the items have no answer column.
ANSWER = 0.25


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def least_edits(part: list[int], own: list[int]) -> int:
    """The least word edits (replaced, added, dropped) that turn part into some run of own: Myers' bit vectors."""
    n = len(part)
    full, last = (1 << n) - 1, 1 << n - 1
    at: dict[int, int] = {}
    for i, t in enumerate(part):
        at[t] = at.get(t, 0) | 1 << i
    up, down, score, best = full, 0, n, n
    for t in own:
        eq = at.get(t, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return best


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + size[i] - 1 of every i, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _grams(terms: list[int]) -> set:
    k = min(GRAM, len(terms))
    return {tuple(terms[i : i + k]) for i in range(len(terms) - k + 1)} if k else set()


class Stats:
    """Of all items: how many, their mean and greatest number of words."""

    def __init__(self, n: int, words: int, longest: int):
        self.n, self.mean, self.longest = n, words / max(1, n), longest

    def impacts(self, words: list[str], df: dict[str, int]) -> dict[str, float]:
        """An item's BM25 weight of each of its terms, as a share of their sum."""
        size = len(words)
        raw = {t: math.log(1 + (self.n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean)) for t, tf in Counter(words).items()}
        full = math.fsum(raw.values())
        return {t: v / full for t, v in raw.items()}


class Index:
    """items: (id, question words, answer words), df: in how many of all items each of their terms is. whole: the two are parts of one text, which may be found as such."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], df: dict[str, int], stats: Stats, threshold: float = THRESHOLD, whole: bool = True):
        self.threshold, self.whole, self.longest = threshold, whole, stats.longest
        self.ids = [i for i, _, _ in items]
        # rare terms have the low numbers: they are the essential ones
        self.terms = {t: i for i, t in enumerate(sorted({w for _, q, a in items for w in (*q, *a)}, key=lambda t: (df[t], t)))}
        self.essential = -1
        found: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for j, (_, q, a) in enumerate(items):
            own = sorted(((self.terms[t], v) for t, v in stats.impacts(q + a, df).items()), reverse=True)
            for t, v in own:
                found[t].append((j, v))
            rest = 0.0
            for t, v in own:  # from the commonest: what they reach together stays below the threshold
                if rest + v >= threshold - SLACK:
                    self.essential = max(self.essential, t)
                    break
                rest += v
        term = np.repeat(np.arange(len(found)), [len(of) for of in found])
        self.item = np.array([j for of in found for j, _ in of], dtype=np.int32)
        self.impact = np.array([v for of in found for _, v in of], dtype=np.float64)
        self.blocks = -(-len(items) // BLOCK)
        # a row a term and block: its first posting, and its greatest impact
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)]) if len(term) else np.zeros(0, dtype=bool)
        begins = np.nonzero(new)[0]
        self.begin = np.append(begins, len(term))
        self.block = self.item[begins] // BLOCK
        self.peak = np.maximum.reduceat(self.impact, begins) if len(begins) else np.zeros(0)
        self.first = np.searchsorted(term[begins], np.arange(len(found) + 1))
        self.parts: list[list[array]] = [[array("i", (self.terms[w] for w in part)) for part in (q, a)] for _, q, a in items]

    def search(self, who: np.ndarray, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item's place, score) of all items that a passage's terms score at or above the threshold. who, terms: passages from 0 and their distinct terms, in order."""
        least = self.threshold - SLACK
        size = self.first[terms + 1] - self.first[terms]
        rows, owner = _ranges(self.first[terms], size), np.repeat(who, size)
        cell = owner * self.blocks + self.block[rows]
        reached = np.bincount(cell, self.peak[rows]) >= least
        pivot = reached[cell]
        rows, owner = rows[pivot], owner[pivot]
        size = self.begin[rows + 1] - self.begin[rows]
        at, owner = _ranges(self.begin[rows], size), np.repeat(owner, size)
        key, back = np.unique(owner * len(self.ids) + self.item[at], return_inverse=True)
        score = np.bincount(back, self.impact[at], minlength=len(key))
        key, score = key[score >= least], score[score >= least]
        return [*zip((key // len(self.ids)).tolist(), (key % len(self.ids)).tolist(), score.tolist())]

    def passages(self, text: str):
        """(first word, term numbers, -1 for words of no item) of every passage that has an essential term.

        Passages are twice as long as the longest of all items and overlap by half, so an item lies whole in one of them.
        """
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)
        stride = max(1, self.longest)
        half = np.unique(np.nonzero((ids >= 0) & (ids <= self.essential))[0] // stride)
        for k in np.unique(np.concatenate([half, half - 1])).tolist():
            if 0 <= k and (k + 1 < -(-len(ids) // stride) or not k):  # the last half is in the passage before
                yield k * stride, ids[k * stride : (k + 2) * stride]

    def found(self, values: list[str]):
        """(text, first word, term numbers, item's place, score) of what reaches the threshold, passage by passage."""
        step = max(1, CELLS // max(1, self.blocks))
        held: list[tuple] = []

        def told():
            size = np.array([len(ids) for _, _, ids in held])
            flat, who = np.concatenate([ids for _, _, ids in held]), np.repeat(np.arange(len(held)), size)
            key = np.unique((who * len(self.terms) + flat)[flat >= 0])
            return [(*held[k], j, score) for k, j, score in self.search(key // len(self.terms), key % len(self.terms))]

        for i, text in enumerate(values):
            for at, ids in self.passages(text):
                held.append((i, at, ids))
                if len(held) == step:
                    yield from told()
                    held = []
        if held:
            yield from told()

    def verified(self, j: int, own: list[int], seen: dict[int, set]) -> list[float] | None:
        """The overlaps of the item's question and answer with a passage, or None if they are too small. seen: the passage's n-grams by length, found when asked for."""
        share = []
        for part in self.parts[j]:
            grams = _grams(part.tolist())
            k = min(GRAM, len(part))
            if k and k not in seen:
                seen[k] = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            share.append(len(grams & seen[k]) / len(grams) if grams else 1.0)
        if min(share) < OVERLAP:
            parts = [p.tolist() for p in self.parts[j]]
            share = [s if s >= OVERLAP else max(s, 1 - least_edits(p, own) / len(p)) for s, p in zip(share, parts)]
            both = parts[0] + parts[1]
            if min(share) < OVERLAP and not (self.whole and least_edits(both, own) <= (1 - OVERLAP) * len(both) + 1e-9):
                return None
        return share

    def hits(self, values: list[str]) -> list[list[tuple[int, float, float, float, int]]]:
        """Of each text (item id, score, question overlap, answer overlap, first word of the passage): the best verified passage of each item, the first of equally good ones."""
        best: list[dict[int, tuple]] = [{} for _ in values]
        last, own, seen = None, [], {}
        for i, at, ids, item, score in self.found(values):
            if item in best[i] and score <= best[i][item][1] + SLACK:
                continue
            if (i, at) != last:
                last, own, seen = (i, at), ids.tolist(), {}
            if share := self.verified(item, own, seen):
                best[i][item] = (self.ids[item], score, *share, at)
        return [[of[k] for k in sorted(of)] for of in best]


def _parts(text: str | None, answer: str | None, has_answer: bool) -> tuple[list[str], list[str]]:
    own = words_of(text or "")
    if has_answer:
        return own, words_of(answer or "")
    cut = len(own) - max(1, int(len(own) * ANSWER)) if len(own) > 1 else len(own)
    return own[:cut], own[cut:]


def prepared(items: DataFrame) -> tuple[DataFrame, Stats]:
    """(item_id, question, answer, terms: structs of term and df) of each different item with words, and what holds for all of them."""
    has_answer = "answer" in items.columns
    own = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col("answer").cast("string") if has_answer else F.lit(None).cast("string")).alias("answer"))

    def split(batches):
        for b in batches:
            rows = [_parts(t, a, has_answer) for t, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1))], names=["item_id", "question", "answer"])

    cut = written(own.mapInArrow(split, "item_id long, question array<string>, answer array<string>").where("size(question) + size(answer) > 0").distinct(), "items")
    size = F.size("question") + F.size("answer")
    n, words, longest = cut.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    each = cut.select("*", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    return each.join(df, "term").groupBy("item_id", "question", "answer").agg(F.collect_list(F.struct("term", "df")).alias("terms")), Stats(n, words, longest)


def indexes(items: DataFrame, threshold: float = THRESHOLD):
    """Indexes of at most INDEX_WORDS words each, but for the last item of one; items come by id, one at a time, so the driver and each broadcast hold a bounded number."""
    rows, stats = prepared(items)
    held, df, size = [], {}, 0
    for r in rows.orderBy("item_id", "question", "answer").toLocalIterator():
        held.append((r.item_id, r.question, r.answer))
        df.update(map(tuple, r.terms))
        size += len(r.question) + len(r.answer)
        if size >= INDEX_WORDS:
            yield Index(held, df, stats, threshold, "answer" not in items.columns)
            held, df, size = [], {}, 0
    if held:
        yield Index(held, df, stats, threshold, "answer" not in items.columns)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: a row for each contaminated row of docs and item in it.

    Null and empty texts are clean. Items without an id or without words are left out; rows of items that repeat count once, and different texts
    of one item_id are items of their own, each with rows of its own. A column named answer in items makes text the question alone; without it the
    last quarter of the text counts as the answer. Of passages of a text that score equally the first is told. Rows of docs that repeat give their
    rows each. No items: no rows. A null doc_id is judged and stays null. No shuffle of docs: each index is broadcast, bounded by INDEX_WORDS.
    """
    own, out = texts(docs), None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    for index in indexes(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, values: list[str], shared=shared):
            x = shared.value
            rows = [(i, *hit) for i, of in enumerate(x.hits(values)) for hit in of]
            cols = [*zip(*rows)] or [()] * 6
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = map_texts(own, run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(shared):
    @F.pandas_udf("boolean")
    def found(v: pd.Series) -> pd.Series:
        return pd.Series([bool(of) for values in in_pieces(v) for of in shared.value.hits(values)], dtype=bool)

    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows in which an item is found, by the same search as contaminated(); all columns stay, as do null and empty texts."""
    out = docs
    for index in indexes(items, threshold):
        found = _finder(docs.sparkSession.sparkContext.broadcast(index))
        out = out.where(~found(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out
