"""Operator 8: repeated byte strings, by suffix arrays of shards.

A string of `size` bytes (100) is repeated if it starts earlier too: in a document with a smaller doc_id, or earlier in the
same one. Every byte that a repeated string covers goes.

1. Anchors. Each string has an anchor, its least-hashed 32-byte gram (leftmost of equals): a function of its bytes alone, so
   equal strings have equal anchors. Neighbouring strings with one anchor form a context. About one byte in 35 is an anchor.
2. Contexts meet by anchor. A context equal to an earlier one is repeated as a whole, and its text is never moved; of those that a
   task meets itself only the first travels. An anchor with a single context is done with. Left are anchors with several different
   contexts: changed copies, shared passages. A common anchor (found by counting a hundredth of the documents; at most COMMON of them)
   does not bring its contexts together: they meet by anchor and context, and all different ones are left for step 3.
3. Only those contexts' bytes are fetched and dealt to shards by anchor; strings that could be equal are then in one shard.
   Contexts are cut down to strings whose hash occurs twice in the shard, and these are sorted by induced sorting (sais.py); runs of
   permuted common prefixes of at least `size` are equal strings, and all but the first of a run are repeated. A shard's chunks are
   bounded; the strings of a common anchor, or of one with more contexts than HOT, are dealt by their own hash instead, so that
   no group needs one task's memory.
4. The spans are put together by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sais import permuted_lcp, suffix_array
from .shared import dropped, freed, pieces, unused, written

SIZE, GRAM = 100, 32
#: String starts handled at once, contexts that meet in a task before they travel, bytes of contexts sorted at once, and contexts of an
#: anchor from which its strings are dealt singly.
SEGMENT, HELD, CHUNK, HOT = 1 << 19, 400_000, 1 << 20, 4000
#: Most common anchors, each of at least that share of the anchors counted.
COMMON = 2000
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64."""
    if base not in _powers:
        n = SEGMENT + 4 * SIZE
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, inverse))
    return _powers[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def contexts(raw: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, two context hashes, first string, number of strings) of each context of some bytes; a context ends size - 1 bytes after its last string's start."""
    n = len(raw) - size + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none, none.astype(np.int64), none.astype(np.int64)
    sums = []
    for base in _BASE:
        up, down = _power(base)
        sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)]), down))
    c, down = sums[0]
    grams = _mix((c[gram:] - c[:-gram]) * down[: len(raw) - gram + 1])
    wide = size - gram + 1
    least = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: n], least[wide - reach : wide - reach + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1])
    count = np.diff(np.append(first, n))
    end = first + count + size - 1
    own = [_mix(_mix((c[end] - c[first]) * down[first]) + count.astype(np.uint64)) for c, down in sums]
    return grams[anchor[first]], *own, first, count


def _docs(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text, more, and a row's key (o, h): o orders documents (no doc_id comes last), h tells the different texts of one doc_id apart.

    h is a number dealt to the different texts of a doc_id that has several, in order of a 128-bit hash of them and their length, and 0 elsewhere;
    only rows that are equal share a key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    own = docs.select(doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("o"), *more)
    told = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(SIZE), "text"), "k3": F.octet_length("text")}
    own = own.withColumns(told)
    kinds = own.select("o", *told).distinct()
    several = kinds.groupBy("o").agg(F.count("*").alias("n")).where("n > 1").select("o")
    dealt = kinds.join(several, "o", "left_semi").repartitionByRange("o", *told).sortWithinPartitions("o", *told).withColumn("h", F.monotonically_increasing_id() + 1)
    return own.join(written(dealt, "texts"), ["o", *told], "left").withColumn("h", F.coalesce("h", F.lit(0).cast("long"))).drop(*told)


#: kind of a context: to be compared, done with (repeated within its task; a span of several such), or of a common anchor.
OPEN, DONE, WIDE = 0, 1, 2
#: A context's strings start at lo and end n bytes further.
_ANCHORS = "a long, c long, d long, o long, h long, lo long, n long, kind byte"


def _runs(o: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans put together, document by document, where they overlap or touch."""
    if not len(o):
        return o, h, lo, hi
    order = np.lexsort((lo, h, o))
    o, h, lo, hi = (x[order] for x in (o, h, lo, hi))
    fresh = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    # tops within a document: documents are told apart by an offset that no end reaches
    wide = int(hi.max()) + 1
    doc = np.cumsum(fresh) - 1
    top = np.maximum.accumulate(hi + doc * wide) - doc * wide
    new = fresh | np.concatenate([[False], lo[1:] > top[:-1]])
    last = np.append(np.nonzero(new)[0][1:] - 1, len(lo) - 1)
    return o[new], h[new], lo[new], top[last]


def _anchors(common: np.ndarray):
    """Every context of every text, as (anchor, context hashes, document, place, kind). common: anchors, sorted, whose contexts don't meet by anchor alone.

    Contexts that the task itself shows to be repeated travel no further than to their document, as spans.
    """

    def met(parts: list[tuple]):
        a, c, d, o, h, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, h, o, d, c, a))
        a, c, d, o, h, pos = (x[order] for x in (a, c, d, o, h, pos))
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        same = (o == o[head]) & (h == h[head]) & (pos == pos[head])  # a row that repeats is not earlier than itself
        done = ~new & ~same
        lo, n = pos >> 8, (pos & 255) + SIZE - 1
        x, y, z, w = _runs(o[done], h[done], lo[done], (lo + n)[done])
        a, c, d, o, h, lo, n = (v[~done] for v in (a, c, d, o, h, lo, n))
        kind = np.zeros(len(a) + len(x), dtype=np.int8)
        if len(common):
            wide = common[np.minimum(np.searchsorted(common, a), len(common) - 1)] == a
            kind[: len(a)][wide] = WIDE
            a = np.where(wide, _mix(a ^ c), a)
        kind[len(a) :] = DONE
        spread = _mix(np.arange(len(x), dtype=np.uint64) + x.view(np.uint64) * np.uint64(_BASE[0]))  # what is done with need not meet
        zero = np.zeros(len(x), dtype=np.uint64)
        cols = [np.append(*v) for v in ((a, spread), (c, zero), (d, zero), (o, x), (h, y), (lo, z), (n, w - z))]
        cols[:3] = [v.view(np.int64) for v in cols[:3]]
        for k in range(0, len(kind), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 20_000]) for v in (*cols, kind)], names=["a", "c", "d", "o", "h", "lo", "n", "kind"])

    def run(batches):
        parts: list[tuple] = []
        size = 0
        for batch, values in pieces(batches):
            o = batch.column(1).to_numpy(zero_copy_only=False)
            h = batch.column(2).to_numpy(zero_copy_only=False)
            for i, v in enumerate(values):
                raw = np.frombuffer(v.encode(), dtype=np.uint8)
                for at in range(0, max(0, len(raw) - SIZE + 1), SEGMENT):
                    a, c, d, first, count = contexts(raw[at : at + SEGMENT + SIZE - 1])
                    parts.append((a, c, d, np.full(len(a), o[i]), np.full(len(a), h[i]), first + at << 8 | count))
                    size += len(a)
                    if size >= HELD:
                        yield from met(parts)
                        parts, size = [], 0
        if parts:
            yield from met(parts)

    return run


#: need: 0 repeated as a whole, 1 to be looked at with others of its anchor, 2 to be looked at string by string.
_DECIDED = "o long, h long, lo long, hi long, a long, need byte"


def _decide(batches):
    """Rows in order of (a, c, d, o, h, lo): contexts that are repeated as a whole, those whose anchor has other contexts too, and all of common anchors."""
    last = None  # the first row of the last run, and whether its anchor had a run before

    def out(o, h, lo, hi, a, need):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (o, h, lo, hi, a)), pa.array(need, pa.int8())], names=["o", "h", "lo", "hi", "a", "need"])

    for batch in batches:
        a, c, d, o, h, lo, n, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        hi = lo + n
        done = kind == DONE
        if done.any():
            yield out(o[done], h[done], lo[done], hi[done], a[done], np.zeros(done.sum(), dtype=np.int8))
            a, c, d, o, h, lo, hi, kind = (x[~done] for x in (a, c, d, o, h, lo, hi, kind))
        if not len(a):
            continue
        if last is not None:
            a, c, d, o, h, lo, hi, kind = (np.concatenate([[y], x]) for x, y in zip((a, c, d, o, h, lo, hi, kind), last[:8]))
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        runs = np.nonzero(new)[0]
        head = runs[np.cumsum(new) - 1]
        gone = ~new & ~((o == o[head]) & (h == h[head]) & (lo == lo[head]))
        alike = np.concatenate([[False], a[runs][1:] == a[runs][:-1], [False]])  # whether a run and the one before share the anchor
        if last is not None:
            alike[0] = last[8]
        closed = len(runs) - 1
        need = np.zeros(len(a), dtype=np.int8)
        need[runs[:closed]] = np.where(kind[runs[:closed]] == WIDE, 2, alike[:closed] | alike[1 : closed + 1])
        x, y, z, w = _runs(o[gone], h[gone], lo[gone], hi[gone])
        yield out(x, y, z, w, np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int8))
        tell = need > 0
        yield out(o[tell], h[tell], lo[tell], hi[tell], a[tell], need[tell])
        k = runs[-1]
        last = (a[k], c[k], d[k], o[k], h[k], lo[k], hi[k], kind[k], bool(alike[closed]))
    if last is not None and (last[8] or last[7] == WIDE):
        yield out(*([x] for x in (last[3], last[4], last[5], last[6], last[0])), [2 if last[7] == WIDE else 1])


def _common(own: DataFrame) -> np.ndarray:
    """Anchors with over HOT different contexts, judged by a hundredth of the documents, and with a share of over 1/COMMON of all there, so fewer than COMMON.

    It only balances tasks: results don't depend on it.
    """
    some = own.where(F.pmod(F.xxhash64("o", "h"), F.lit(100)) == 0).select("text", "o", "h").mapInArrow(_anchors(np.zeros(0, dtype=np.uint64)), _ANCHORS).where(f"kind = {OPEN}")
    counted = written(some.select("a", "c", "d").distinct().groupBy("a").agg(F.count("*").alias("n")), "anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = [r.a for r in counted.where(F.col("n") > max(HOT / 100, total / COMMON)).select("a").collect()]
    dropped(counted)
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def _fetch(batches):
    """The bytes of the contexts that are needed of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column(0)[i].as_py().encode()
            o, h = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            need = batch.column(3)[i].values
            lo, hi, a, hot = (need.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for k in range(0, len(lo), 5000):
                at = lo[k : k + 5000]
                own = [raw[x:y] for x, y in zip(at.tolist(), hi[k : k + 5000].tolist())]
                m = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + m]), pa.array([o] * m, pa.int64()), pa.array([h] * m, pa.int64()), pa.array(at), pa.array(own, pa.binary()), pa.array(hot[k : k + m].astype(bool))], names=["a", "o", "h", "at", "own", "hot"])


_SPANS = "o long, h long, lo long, hi long"


def _spans(o, h, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["o", "h", "lo", "hi"])


def _hashed(flat: np.ndarray, base: int = _BASE[0]) -> np.ndarray:
    """A hash of every string of SIZE bytes."""
    up, down = _power(base)
    out = [np.zeros(0, dtype=np.uint64)]
    for at in range(0, len(flat) - SIZE + 1, SEGMENT):
        part = flat[at : at + SEGMENT + SIZE - 1]
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        out.append(_mix((c[SIZE:] - c[:-SIZE]) * down[: len(part) - SIZE + 1]))
    return np.concatenate(out)


def _hashed_strings(own: list[bytes], bases=_BASE[:1]) -> tuple[np.ndarray, ...]:
    """(context, offset in it, a hash for each base) of every string of some contexts."""
    flat = np.frombuffer(b"".join(own), dtype=np.uint8)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    hashes = [_hashed(flat, b) for b in bases]
    which = np.repeat(np.arange(len(own)), size)[: len(hashes[0])]
    offset = np.arange(len(which)) - start[which]
    whole = offset + SIZE <= size[which]
    return which[whole], offset[whole], *(x[whole] for x in hashes)


def _doubtful(at: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The contexts with a string whose hash another string has too, cut down to what lies between such strings: their places in own, their starts and bytes.

    A string with a hash of its own equals no other, so no repeated string is lost; equal hashes prove nothing, which is left to the sorting.
    """
    which, offset, hashes = _hashed_strings(own)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared = np.zeros(len(hashes), dtype=bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    which, offset = which[shared], offset[shared]
    left, first = np.unique(which, return_index=True)
    last = np.append(first[1:], len(which)) - 1
    return left, at[left] + offset[first], [own[i][a : b + SIZE] for i, a, b in zip(left.tolist(), offset[first].tolist(), offset[last].tolist())]


def shard(o: np.ndarray, h: np.ndarray, at: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, ...]:
    """(o, h, lo, hi) of the repeated strings of contexts, string runs joined."""
    left, at, own = _doubtful(at, own)
    if not len(left):
        return (np.zeros(0, dtype=np.int64),) * 4
    o, h = o[left], h[left]
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    t = np.zeros(int((size + 1).sum()), dtype=np.int64)
    flat = np.frombuffer(b"\0".join(own) + b"\0", dtype=np.uint8)
    t[:] = flat
    t += 1
    t[start + size] = 0
    sa = suffix_array(t)
    shared = permuted_lcp(t, sa)[sa]
    which = np.repeat(np.arange(len(own)), size + 1)
    whole = np.zeros(len(t), dtype=bool)
    offset = np.arange(len(t)) - start[which]
    whole = offset + SIZE <= size[which]
    run = np.cumsum(shared < SIZE)
    keep = whole[sa]
    p, run = sa[keep], run[keep]
    k = which[p]
    place = at[k] + offset[p]
    order = np.lexsort((place, h[k], o[k], run))
    p, run, k, place = p[order], run[order], k[order], place[order]
    new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, dtype=bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    gone = ~new & ~((o[k] == o[k[head]]) & (h[k] == h[k[head]]) & (place == place[head]))
    p = np.sort(p[gone])
    if not len(p):
        return (np.zeros(0, dtype=np.int64),) * 4
    first = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (which[p[1:]] != which[p[:-1]])])
    a, b = p[first], p[np.append(np.nonzero(first)[0][1:] - 1, len(p) - 1)]
    k = which[a]
    return o[k], h[k], at[k] + offset[a], at[k] + offset[b] + SIZE


def _shards(batches):
    """Contexts in order of anchor: sorted in chunks of whole anchors."""
    held: list[tuple] = []
    size, last = 0, None

    def flush():
        return _spans(*shard(np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.array([x[2] for x in held]), [x[3] for x in held]))

    for batch in batches:
        for a, o, h, at, own in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if a != last and size >= CHUNK:
                yield flush()
                held, size = [], 0
            held.append((o, h, at, own))
            size += len(own)
            last = a
    if held:
        yield flush()


_STRINGS = "w1 long, w2 long, o long, h long, lo long, hi long, done boolean"


def _strings(batches):
    """Each string of common anchors' contexts by 128 bits of its hash. Of equal ones in a task only the first travels to meet others; the rest are done with, as spans."""

    def met(parts: list[tuple]):
        w1, w2, o, h, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, h, o, w2, w1))
        w1, w2, o, h, at = (x[order] for x in (w1, w2, o, h, at))
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        head = np.nonzero(new)[0][np.cumsum(new) - 1]
        gone = ~new & ~((o == o[head]) & (h == h[head]) & (at == at[head]))
        x, y, z, to = _runs(o[gone], h[gone], at[gone], at[gone] + SIZE)
        spread = _mix(np.arange(len(x), dtype=np.uint64) + w1[0]).view(np.int64)
        zero = np.zeros(len(x), dtype=np.int64)
        keep = ~gone
        cols = (np.append(w1.view(np.int64)[keep], spread), np.append(w2.view(np.int64)[keep], zero), np.append(o[keep], x), np.append(h[keep], y), np.append(at[keep], z), np.append(at[keep] + SIZE, to))
        done = np.append(np.zeros(int(keep.sum()), dtype=bool), np.ones(len(x), dtype=bool))
        for k in range(0, len(done), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000]) for c in (*cols, done)], names=["w1", "w2", "o", "h", "lo", "hi", "done"])

    parts: list[tuple] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        o, h, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        which, offset, w1, w2 = _hashed_strings(batch.column(3).to_pylist(), _BASE)
        parts.append((w1, w2, o[which], h[which], at[which] + offset))
        size += len(which)
        if size >= HELD:
            yield from met(parts)
            parts, size = [], 0
    if size:
        yield from met(parts)


def _later(batches):
    """Strings in order of (hash, document, place): all but each hash's first, and what is done with."""
    last = None
    for batch in batches:
        w1, w2, o, h, at, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        done = batch.column(6).to_numpy(zero_copy_only=False)
        if done.any():
            yield _spans(o[done], h[done], at[done], hi[done])
        cols = [x[~done] for x in (w1, w2, o, h, at)]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([[y], x]) for x, y in zip(cols, last)]
        w1, w2, o, h, at = cols
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        head = np.nonzero(new)[0][np.cumsum(new) - 1]
        gone = ~new & ~((o == o[head]) & (h == h[head]) & (at == at[head]))
        yield _spans(*_runs(o[gone], h[gone], at[gone], at[gone] + SIZE))
        last = [x[head[-1]] for x in cols]


_BY_DOC = "o long, h long, spans array<struct<lo: long, hi: long>>"


def _by_document(batches):
    """Spans in order of (o, h, lo): a row a document, its spans put together as they come."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    held: list[tuple] = []  # the runs of the document that may go on
    key = None

    def out(keys, lists):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(lists, kind)], names=["o", "h", "spans"])

    for batch in batches:
        if not batch.num_rows:
            continue
        o, h, lo, hi = _runs(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
        starts = np.nonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))[0].tolist()
        keys, lists = [], []
        for a, b in zip(starts, [*starts[1:], len(o)]):
            own, now = [*zip(lo[a:b].tolist(), hi[a:b].tolist())], (int(o[a]), int(h[a]))
            if now == key:
                for x, y in own:
                    if x <= held[-1][1]:
                        held[-1] = (held[-1][0], max(held[-1][1], y))
                    else:
                        held.append((x, y))
            else:
                if key is not None:
                    keys.append(key)
                    lists.append([{"lo": x, "hi": y} for x, y in held])
                key, held = now, own
        if keys:
            yield out(keys, lists)
    if key is not None:
        yield out([key], [[{"lo": x, "hi": y} for x, y in held]])


def repeated_spans(own: DataFrame) -> DataFrame:
    """(o, h, spans) from rows of _docs(): by row key, the spans of repeated strings, in order and apart."""
    spark = own.sparkSession
    met = own.select("text", "o", "h").mapInArrow(_anchors(_common(own)), _ANCHORS)
    met = met.repartition(F.col("a")).sortWithinPartitions("a", "c", "d", "o", "h", "lo")
    decided = written(met.mapInArrow(_decide, _DECIDED), "decided")
    freed(spark)
    need = decided.where("need > 0")
    hot = need.where("need = 1").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a", F.lit(True).alias("hot"))
    need = need.join(hot, "a", "left").select("o", "h", F.struct("lo", "hi", "a", (F.coalesce("hot", F.lit(False)) | (F.col("need") == 2)).alias("hot")).alias("x")).groupBy("o", "h").agg(F.collect_list("x").alias("need"))
    fetched = written(own.select("text", "o", "h").dropDuplicates(["o", "h"]).join(need, ["o", "h"]).select("text", "o", "h", "need").mapInArrow(_fetch, "a long, o long, h long, at long, own binary, hot boolean"), "contexts")
    freed(spark)
    cold = fetched.where("not hot").select("a", "o", "h", "at", "own").repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(_shards, _SPANS)
    strings = fetched.where("hot").select("o", "h", "at", "own").mapInArrow(_strings, _STRINGS)
    warm = strings.repartition(F.col("w1"), F.col("w2")).sortWithinPartitions("w1", "w2", "o", "h", "lo").mapInArrow(_later, _SPANS)
    whole = decided.where("need = 0").select("o", "h", "lo", "hi")
    every = whole.union(cold).union(warm)
    return written(every.repartition(F.col("o"), F.col("h")).sortWithinPartitions("o", "h", "lo").mapInArrow(_by_document, _BY_DOC), "spans")


def cut(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row a row of docs, and if wanted kept (the bytes left) and spans (what went).

    A null or empty text, or one of fewer than 100 bytes, loses nothing. Rows that repeat as a whole are one document: none is earlier than
    the other. Rows that share a doc_id with other texts are ordered by a hash of the text. A null doc_id comes after all others.
    """
    keyed = _docs(docs)
    spans = repeated_spans(keyed)
    freed(docs.sparkSession)
    own = keyed.join(spans, ["o", "h"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            col = batch.column(2)
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                lo = hi = np.zeros(0, dtype=np.int64)
                if col[i].is_valid:
                    lo, hi = (col[i].values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                parts, at = [], 0
                for a, b in zip(lo.tolist(), hi.tolist()):
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                for c, x in zip(rows, (len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept if with_text else None, [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())] if with_text else None)):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            n = 6 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows[:n], kinds))], names=["doc_id", *names[:n]])

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<lo: long, hi: long>>" * with_text)


def trimmed(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut from text; all other columns stay. A character that a cut divides goes with it. A null text stays null."""
    row, found = unused(docs, "whole_row"), unused(docs, "span_list")
    keyed = _docs(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))
    spans = repeated_spans(keyed)
    freed(docs.sparkSession)
    met = keyed.select("o", "h", row).join(spans, ["o", "h"], "left").select(f"{row}.*", F.col("spans").alias(found))
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            cols, names = batch.columns[:-1], batch.schema.names[:-1]
            own, cuts = cols[text].to_pylist(), batch.column(len(cols))
            for i in np.nonzero(np.asarray(cuts.is_valid()))[0].tolist():
                lo, hi = (cuts[i].values.field(k).to_pylist() for k in (0, 1))
                raw = own[i].encode()
                own[i] = "".join(raw[a:b].decode(errors="ignore") for a, b in zip([0, *hi], [*lo, len(raw)]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()) if k == text else c for k, c in enumerate(cols)], names=names)

    return met.mapInArrow(run, docs.schema)
