"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The scan that induces goes over buckets (first symbols). A bucket is taken round by round, each round being all suffixes that
the one before placed in the same bucket; small buckets are taken several at a time, as far as none of them places a suffix in
another of them. So the work is vectorised, whatever the alphabet, and the order is that of a scan suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of neighbouring buckets that are taken at once.
BATCH = 2048


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes, induced from those at lms (in the order that each bucket shall have them). small: whether a suffix is less than the next.

    Each bucket fills from its head with larger suffixes, in ascending order, then from its tail with smaller ones, in descending order.
    """
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    bounds = [0, *end.tolist()]
    out = np.full(n, -1, dtype=np.int32)
    ramp = np.arange(n + 1)

    def before(now: np.ndarray, want: bool) -> np.ndarray:
        """Predecessors of the wanted type, in order."""
        found = now[now > 0] - 1
        return found[small[found] == want]

    def put(found: np.ndarray, symbol: np.ndarray, free: np.ndarray, down: bool) -> None:
        """Places suffixes, in order, at their buckets' free places."""
        if not len(found):
            return
        order = np.argsort(symbol, kind="stable")
        found, symbol = found[order], symbol[order]
        at = ramp[: len(symbol)]
        rank = at - np.maximum.accumulate(np.where(np.concatenate(([True], symbol[1:] != symbol[:-1])), at, 0))
        place = free[symbol] - rank - 1 if down else free[symbol] + rank
        out[place] = found
        free[symbol] = place if down else place + 1  # of a bucket's places the last one written counts

    # seeds wait at the tails of their buckets
    tail = end.copy()
    put(lms[::-1], t[lms[::-1]], tail, True)
    head, c, wide = start.copy(), 0, BATCH
    while c < k:
        d = c + 1
        while d < k and bounds[d + 1] - bounds[c] <= wide:
            d += 1
        if d > c + 1:
            found = before(out[bounds[c] : bounds[d]], False)
            symbol = t[found]
            inner = symbol[symbol < d]
            if len(inner):
                d, wide = int(inner.min()), max(16, wide // 2)
                found = before(out[bounds[c] : bounds[d]], False)
                symbol = t[found]
            else:
                wide = min(BATCH, 2 * wide)
            if d > c:
                put(found, symbol, head, False)
                c = d
                continue
        at = bounds[c]
        while at < (to := int(head[c])):
            found = before(out[at:to], False)
            put(found, t[found], head, False)
            at = to
        found = before(out[tail[c] : end[c]], False)
        put(found, t[found], head, False)
        c += 1
    out[ramp[:n] >= np.repeat(head, size)] = -1
    tail, d, wide = end.copy(), k, BATCH
    while d > 0:
        c = d - 1
        while c > 0 and bounds[d] - bounds[c - 1] <= wide:
            c -= 1
        if c < d - 1:
            found = before(out[bounds[c] : bounds[d]][::-1], True)
            symbol = t[found]
            inner = symbol[symbol >= c]
            if len(inner):
                c, wide = int(inner.max()) + 1, max(16, wide // 2)
                found = before(out[bounds[c] : bounds[d]][::-1], True)
                symbol = t[found]
            else:
                wide = min(BATCH, 2 * wide)
            if c < d:
                put(found, symbol, tail, True)
                d = c
                continue
        d -= 1
        at = bounds[d + 1]
        while at > (to := int(tail[d])):
            found = before(out[to:at][::-1], True)
            put(found, t[found], tail, True)
            at = to
        found = before(out[bounds[d] : head[d]][::-1], True)
        put(found, t[found], tail, True)
    out[0] = n - 1
    return out


def _sort(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of t, whose last symbol is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    nearest = np.minimum.accumulate(np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))[::-1])[::-1]
    small = np.append((t[1:] > t[:-1])[nearest], True)
    lms = (np.nonzero(small[1:] & ~small[:-1])[0] + 1).astype(np.int32)
    first = _induce(t, small, lms, k)
    place = np.zeros(n, dtype=bool)
    place[lms] = True
    ranked = first[place[first]]
    # names: equal leftmost-smaller substrings share one
    following = np.append(lms[1:], np.int32(n - 1))
    width = np.zeros(n, dtype=np.int32)
    width[lms] = following - lms
    a, b = ranked[:-1], ranked[1:]
    differ = width[a] != width[b]
    live, depth = np.nonzero(~differ)[0], 0
    while len(live):
        unlike = t[a[live] + depth] != t[b[live] + depth]
        differ[live[unlike]] = True
        live = live[~unlike]
        live = live[width[a[live]] > depth]
        depth += 1
    name = np.zeros(n, dtype=np.int32)
    name[ranked] = np.concatenate([[0], np.cumsum(differ)])
    names, count = name[lms], int(differ.sum()) + 1
    if count < len(lms):
        order = _sort(names.astype(np.uint16) if count < 1 << 16 else names, count)
        ranked = lms[order]
    return _induce(t, small, ranked, k)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols (small whole numbers from 0), in order."""
    if not len(symbols):
        return np.zeros(0, dtype=np.int64)
    t = np.append(symbols.astype(np.int64) + 1, 0)
    most = int(t.max())
    if most >= 1 << 16 or len(t) >= 1 << 31:
        raise ValueError("symbols must be under 65,535, and under 2**31 in number")
    return _sort(t.astype(np.uint16), most + 1)[1:].astype(np.int64)


def permuted_lcp(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position: how many symbols a suffix shares with the one before it in sa (0 for the first).

    Only irreducible values are compared symbol by symbol (those whose left neighbours differ); any other is its left neighbour's less one.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    open_ = (before < 0) | (at == 0) | (before == 0)
    whole = ~open_
    open_[whole] = symbols[at[whole] - 1] != symbols[before[whole] - 1]
    live = np.nonzero(open_ & (before >= 0))[0]
    out = np.zeros(n, dtype=np.int64)
    depth = 0
    padded = np.append(symbols.astype(np.int64), -1)
    while len(live):
        i, j = live + depth, before[live] + depth
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        live = live[padded[i] == padded[j]]
        depth += 1
        out[live] = depth
    last = np.maximum.accumulate(np.where(open_, at, 0))
    return np.maximum(out[last] - (at - last), 0)
