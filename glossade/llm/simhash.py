"""Operator 9: SimHash near-duplicates by pigeonhole blocks.

Fingerprints are reduced to the distinct ones first. A fingerprint of 64 bits is cut into 6 blocks; two that differ in at
most 3 bits agree in at least 3 blocks, so they meet in one of the 20 tables keyed by 3 blocks. A bucket of a table is
compared in one task by XOR and bit count, and only links that join different trees of the bucket are kept, so the number
of links stays linear. A bucket of more than BUCKET fingerprints is cut again: its 30 to 33 free bits into 8 parts, of which
at least 5 agree, so that at most 2**14 different fingerprints can meet again: a proven bound, whatever the input.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import map_texts, texts, written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS, BUCKET = 64, 1024
#: Shingles hashed at once.
STEP = 1 << 15


def shingle_hashes(text: str, words: int = 3, seed: int = 42):
    """XXH64 of every shingle, repeats included, in blocks; fewer words than a shingle are one shingle; no words give nothing."""
    found = WORDS.findall(text.encode().translate(LOWER))
    if not found:
        return
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = (np.cumsum(size) + np.arange(len(found))).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(words, len(found))
    h = xxhash.xxh64_intdigest
    for at in range(0, len(found) - k + 1, STEP):
        to = min(at + STEP, len(found) - k + 1)
        yield np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1])), dtype=np.uint64, count=to - at)


def majority(hashes) -> int:
    """The fingerprint of shingle hashes, which come in blocks: a bit is 1 if it is set in over half of them; 0 without any."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)  # a block has under 2**16 rows
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), a row a row of docs."""

    def run(batch: pa.RecordBatch, values: list[str]):
        fp = np.array([fingerprint(v, words, seed) for v in values], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_texts(texts(docs), run, "doc_id long, fp long")


def _cuts(places: list[int], parts: int) -> list[list[int]]:
    """Bit places in so many runs of nearly equal length."""
    return [places[len(places) * i // parts : len(places) * (i + 1) // parts] for i in range(parts)]


def masks(places: list[int], parts: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` of so many parts."""
    return [sum(1 << b for part in pick for b in part) for pick in combinations(_cuts(places, parts), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(ms: list[int]) -> Column:
    """An array of (table, key) of column fp."""
    return F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for i, m in enumerate(ms)))


def forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Index pairs at `bits` or fewer differing bits that join all values which such links connect: a spanning forest, by breadth from each least one."""
    left, out = np.arange(len(values)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(values[left] ^ values[i]) <= bits
            for j in left[near].tolist():
                out.append((i, j))
                queue.append(j)
            left = left[~near]
    return out


def _links(buckets: DataFrame, bits: int) -> DataFrame:
    """(a, b) of each bucket's forest; buckets have an array column fps, of a bounded length."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            col = batch.column(0)
            for i in range(batch.num_rows):
                v = np.unique(col[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                for x, y in forest(v, bits):
                    a.append(v[x])
                    b.append(v[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, bits: int = 3, parts: int = 6, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all that pairs at `bits` or fewer differing bits connect.

    parts blocks, of which parts - bits agree. distinct must be a written table: it is read more than once.
    """
    ms = masks(list(range(BITS)), parts, parts - bits)
    dealt = distinct.select("fp", F.explode(_keys(ms)).alias("x")).select("fp", "x.t", "x.k")
    size = dealt.groupBy("t", "k").agg(F.count("*").alias("n"))
    shared = written(size.where("n > 1"), "buckets")
    met = dealt.join(shared, ["t", "k"])
    small = met.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    out = _links(small, bits)
    free = [[b for b in range(BITS) if not m >> b & 1] for m in ms]
    fine = [masks(places, 8, 8 - bits) for places in free]
    again = F.array(*(F.array(*(F.lit(_signed(m)).cast("long") for m in of)) for of in fine))
    hot = met.where(F.col("n") > bucket).select("t", "k", "fp", F.posexplode(F.element_at(again, F.col("t") + 1)).alias("t2", "m")).select("t", "k", "fp", "t2", F.col("fp").bitwiseAND(F.col("m")).alias("k2"))
    hot = hot.groupBy("t", "k", "t2", "k2").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return out.union(_links(hot, bits)).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links of at most `bits` differing bits), a row a row of docs.

    A null or empty text has fingerprint 0 and is linked like any other. Equal fingerprints are one node, so that thousands of copies make no
    pairs. Rows that repeat a doc_id stay and are judged by their own text; a null doc_id keeps its row, and its component is the least doc_id there is.
    """
    own = written(fingerprints(docs, words, seed), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = written(components(links(distinct.select("fp"), bits)), "components")
    least = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(roots, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
