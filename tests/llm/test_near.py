import random
import re

import xxhash
from pyspark.sql import functions as F

from glossade.llm import repeats, similar, simhash
from glossade.llm.graph import components

from .conftest import ODD


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(500, 500)] + [(600 + i, 601 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)]
    ids = sorted({x for e in edges for x in e})
    pairs = {frozenset(e) for e in edges}
    want = closure(ids, lambda a, b: frozenset((a, b)) in pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([(1, None)], "a long, b long")).count() == 0


def near_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(30, 120))
        rows.append((3 * i, " ".join(base)))
        for k in range(rng.randint(0, 2)):
            c = list(base)
            c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((3 * i + 1 + k, " ".join(c)))
    return rows


def test_simhash_is_the_definition(spark, make):
    rows = near_texts(80) + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one two"), (1004, "ONE TWO"), (1005, "É one two")]
    fp = {d: brute_fp(t) for d, t in rows}
    want = closure(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: r for r in simhash.near_duplicates(make(rows)).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in fp.items()}
    assert {d: r.component_id for d, r in got.items()} == want


def test_simhash_hot_buckets(spark):
    """Distinct fingerprints that crowd one bucket are cut again, and no link is lost."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        x = base
        for b in rng.sample(range(40, 64), rng.randint(1, 9)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = closure(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=20)
    assert edges.count() < 40 * len(fps)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert classes({k: got.get(k, k) for k in want}) == classes(want)


def test_odd_rows(spark, make):
    got = simhash.near_duplicates(make(ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(make([])).count() == 0


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_recall_and_rest(spark, make):
    rows = near_texts(150, 7)
    sh = {d: shingles(t) for d, t in rows}
    ids = sorted(sh)
    J = {(a, b): len(sh[a] & sh[b]) / len(sh[a] | sh[b]) for i, a in enumerate(ids) for b in ids[:i] if a // 3 == b // 3}
    got = {r.doc_id: r.component_id for r in similar.groups(make(rows)).collect()}
    close = [p for p, j in J.items() if j >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close) > 20
    assert all(got[d] // 3 == d // 3 for d in ids)  # nothing unrelated is joined


def test_similar_large_groups(spark, make, monkeypatch):
    """A group of close copies far larger than a bucket may be comes out whole, and takes nothing else in."""
    monkeypatch.setattr(similar, "BUCKET", 12)
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(200):
        c = list(base)
        c[rng.randrange(len(c))] = f"w{i}"
        rows.append((i, " ".join(c)))
    rows += [(1000 + d, t) for d, t in near_texts(30, 5)]
    got = {r.doc_id: r.component_id for r in similar.groups(make(rows)).collect()}
    assert {got[i] for i in range(200)} == {0} and all(got[d] >= 1000 for d in got if d >= 1000)


def exact_groups(rows):
    sh = {d: shingles(t) for d, t in rows}
    return closure(sorted(sh), lambda a, b: 5 * len(sh[a] & sh[b]) >= 4 * len(sh[a] | sh[b]))


def got_groups(make, rows):
    return {r.doc_id: r.component_id for r in similar.groups(make(rows)).collect()}


def test_similar_small_groups_in_a_large_bucket(spark, make, monkeypatch):
    """Texts of one template, below the similarity to one another, with many small groups of copies among them."""
    monkeypatch.setattr(similar, "BUCKET", 12)
    monkeypatch.setattr(similar, "SHINGLES", 1500)
    rng = random.Random(21)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(120):
        own = base + [f"u{i}x{k}" for k in range(24)]
        rows.append((2 * i, " ".join(own)))
        if i % 3 == 0:
            at = rng.randrange(len(own))
            rows.append((2 * i + 1, " ".join(own[:at] + [f"c{i}"] + own[at + 1 :])))
    want = exact_groups(rows)
    assert len(set(want.values())) == 120 and got_groups(make, rows) == want


def test_similar_short_texts(spark, make):
    """Texts of 9 to 12 words less their first or last word are at 0.8 or more; of 8 words and less they are not."""
    rows = []
    for i in range(40):
        own = [f"s{i}x{k}" for k in range(3 + i % 10)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(own[1:])), (3 * i + 2, " ".join(own[:-1]))]
    want = exact_groups(rows)
    assert len(set(want.values())) < len(rows) - 20 and got_groups(make, rows) == want


def test_similar_is_the_definition(spark, make):
    """Pairs on both sides of 0.8 are joined or left apart by their exact similarity."""
    rng = random.Random(31)
    rows = []
    for i in range(200):
        own = [f"d{i}x{k}" for k in range(rng.randint(20, 150) if i % 10 else rng.randint(400, 1500))]
        other = list(own)
        for k in rng.sample(range(len(own)), rng.randint(1, max(1, len(own) // 35 + 1))):
            other[k] = f"e{i}x{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    want = exact_groups(rows)
    assert 220 < len(set(want.values())) < 380 and got_groups(make, rows) == want


def test_similar_without_simhash(spark, make, monkeypatch):
    """The prefix filter alone finds the same groups, with all buckets large and no shingle known to be common."""
    rng = random.Random(41)
    shared = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(60):
        own = [f"d{i}x{k}" for k in range(rng.randint(30, 90))]
        own[5:5] = shared * (i % 2)
        rows.append((10 * i, " ".join(own)))
        for c in range(rng.randint(0, 5)):
            other = list(own)
            for k in rng.sample(range(len(own)), rng.randint(1, 3)):
                other[k] = f"e{i}x{c}x{k}"
            rows.append((10 * i + 1 + c, " ".join(other)))
    want = exact_groups(rows)
    assert 60 < len(set(want.values())) < len(rows) - 30
    assert got_groups(make, rows) == want
    monkeypatch.setattr(similar, "_close", lambda own: own.select(F.col("node").alias("a"), F.col("node").alias("b")).where("1 = 0"))
    monkeypatch.setattr(similar, "SMALL", 0)
    monkeypatch.setattr(similar, "COMMON", 1000)
    assert got_groups(make, rows) == want


def test_meeting_over_batches():
    """Keys whose rows lie in several batches are told as in one."""
    rng = random.Random(3)
    key = sorted(rng.choices(range(60), k=70))
    rows = [(k, i, k % 17 == 0) for i, k in enumerate(key)]
    want = [(k, i) for k, i, c in rows if key.count(k) > 1 or c]
    for step in (1, 2, 3, 50, 100):
        batches = [similar.pa.RecordBatch.from_arrays([similar.pa.array(x) for x in zip(*rows[at : at + step])], names=["key", "node", "common"]) for at in range(0, len(rows), step)]
        got = [(k, i) for out in similar._meeting(iter(batches)) for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert got == want, step
    assert [*similar._meeting(iter([]))] == []


def test_one_of_each(spark, make):
    rows = [(4, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "quite another text of many words here now"), (2, "a b c d e f g h i j"), (None, "x"), (9, None), (8, "")]
    got = similar.one_of_each(make(rows)).select("doc_id").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 2), (True, 3), (True, 8)]
    assert similar.one_of_each(make([])).count() == 0


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(raw[i : i + size])
        out[d] = bytes(x for x, g in zip(raw, gone) if not g), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
    return out


def repeat_rows(n=60, seed=6):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcde fghé\n", k=rng.randint(80, 400))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randint(50, 400)], "".join(rng.choices("xyz é", k=rng.randint(0, 120)))]
        rows.append((i, "".join(parts)))
    return [*rows, (100, "ab" * 500), (101, "a" * 333), (102, None), (103, ""), (104, "z" * 99), (105, "z" * 101)]


def check_repeats(make, rows):
    want = brute_repeats(rows)
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in repeats.cut(make(rows)).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_repeats_are_the_definition(spark, make):
    check_repeats(make, repeat_rows())


def test_repeats_of_hot_anchors_and_long_texts(spark, make, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    check_repeats(make, repeat_rows(seed=8))


def test_repeats_of_common_anchors(spark, make, monkeypatch):
    """Anchors taken for common ones, with few contexts held in a task, change nothing."""
    every = repeats._anchors(repeats.np.zeros(0, dtype=repeats.np.uint64))
    rows = repeat_rows(40, 9)
    found = set()
    for d, t in rows:
        batch = repeats.pa.RecordBatch.from_arrays([repeats.pa.array([t or ""]), repeats.pa.array([d]), repeats.pa.array([0], repeats.pa.int64())], names=["text", "o", "h"])
        for out in every(iter([batch])):
            found.update(out.column(0).to_pylist())
    half = repeats.np.sort(repeats.np.array(sorted(found)[::2], dtype=repeats.np.int64).view(repeats.np.uint64))
    monkeypatch.setattr(repeats, "_common", lambda own: half)
    monkeypatch.setattr(repeats, "HELD", 50)
    check_repeats(make, rows)


def test_common_anchors_are_few(spark, make):
    same = "".join(random.Random(3).choices("abcdefgh ", k=40))
    rows = [(i, "".join(random.Random(i).choices("klmnopq ", k=60)) + same + "".join(random.Random(-i - 1).choices("rstuvw ", k=60))) for i in range(3000)]
    found = repeats._common(repeats._docs(make(rows)))
    assert len(found) < repeats.COMMON
    check = repeats._common(repeats._docs(make([])))
    assert len(check) == 0


def test_segments(monkeypatch):
    raw = repeats.np.random.default_rng(1).integers(97, 101, 5000, dtype=repeats.np.uint8)
    a, c, d, first, count = repeats.contexts(raw)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(raw) - 99
    assert count.max() <= 69


def test_repeats_odd_rows(spark, make):
    got = repeats.cut(make(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and by[5].n_removed == 0 and by[8].n_removed == 149_999
    assert repeats.cut(make([])).count() == 0
    twins = [(5, "abc " * 60), (5, "abc " * 60)]
    assert len({r.kept_sha256 for r in repeats.cut(make(twins)).collect()}) == 1


def test_rows_are_told_apart_whatever_their_hashes(spark, make):
    """Two texts of one doc_id with equal 32-bit hashes: what one of them loses is not cut from the other."""
    many = spark.range(300_000).selectExpr("concat(" + ", ".join(f"md5(string(id * 7 + {k}))" for k in range(6)) + ") as text").selectExpr("text", "hash(text) as h")
    pair = [r.text for r in many.groupBy("h").agg({"text": "collect_list"}).where("size(`collect_list(text)`) > 1").selectExpr("h", "explode(`collect_list(text)`) as text").orderBy("h", "text").limit(2).collect()]
    assert len(pair) == 2
    for ids in ((7, 7), (7, 8), (None, None)):
        rows = [(1, "start " + pair[0]), *zip(ids, pair)]
        lost = sorted(r.n_removed for r in repeats.cut(make(rows)).collect())
        assert lost == [0, 0, 192], ids


def test_rows_without_ids_are_the_definition(spark, make):
    """Rows that share an id, or have none, are documents of their own, in order of the hash of their text; equal rows are one."""
    texts = [t for _, t in repeat_rows(300, 12) if t]
    rows = [(None, t) for t in texts] + [(4, t) for t in texts[:40]] + [(4, texts[3])] * 3 + [(9, "q" * 150)]
    place = {r.text: r.k for r in make(rows).selectExpr("text", "xxhash64(text) as k").collect()}
    want = brute_repeats([(k, k[2]) for k in {(1 << 63 if d is None else d, place[t], t) for d, t in rows}])
    got = repeats.cut(make(rows)).collect()
    assert len(got) == len(rows)
    told = {(1 << 63 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in got}
    assert told == {(k[0], len(k[2].encode()), *v) for k, v in want.items()}


def test_trimmed_keeps_columns(spark, make):
    rows = [(1, "é" * 80), (2, "Xé" + "é" * 80), (3, None)]
    df = make(rows)
    got = {r.doc_id: r for r in repeats.trimmed(df).collect()}
    assert repeats.trimmed(df).columns == df.columns
    assert got[1].text.startswith("é") and got[3].text is None and got[2].text.startswith("X") and len(got[2].text) < 40
