import random
import zlib

import pytest

from glossade.llm import decontaminate as D
from glossade.llm import language as L
from glossade.llm import toxicity as T

from .conftest import ODD


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(3)
    common = words(rng, 40)
    items = [(i, rng.sample(common, 8) + words(rng, rng.randint(6, 50)) + rng.sample(common, 8)) for i in range(150)]
    return common, [(i, " ".join(rng.sample(w, len(w)))) for i, w in items]


def index_of(items, **more):
    """An index of (id, text) items, with the counts of those alone."""
    cut = [(i, *D._parts(t, None, False)) for i, t in items]
    df = D.Counter(w for _, q, a in cut for w in {*q, *a})
    sizes = [len(q) + len(a) for _, q, a in cut]
    return D.Index(cut, df, D.Stats(len(cut), sum(sizes), max(sizes)), **more)


def plain_scores(items):
    """By item: BM25 weights of its terms as shares of their sum, from the definition."""
    import math

    own = {i: D.words_of(t) for i, t in items}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = {w: sum(w in v for v in own.values()) for v in own.values() for w in v}
    out = {}
    for i, v in own.items():
        raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * v.count(w) * 2.2 / (v.count(w) + 1.2 * (0.25 + 0.75 * len(v) / mean)) for w in v}
        out[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    return out


def test_search_is_exact(bench, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)  # many blocks a term
    common, items = bench
    index = index_of(items)
    assert index.blocks > 30 and D.np.diff(index.first).max() > 16 and (D.np.diff(index.begin) > 1).any()
    scores = plain_scores(items)
    rng = random.Random(1)
    hits = 0
    for _ in range(300):
        i = rng.randrange(len(items))
        own = D.words_of(items[i][1])
        passage = rng.sample(own, int(len(own) * rng.random())) + rng.sample(common, 10) + words(rng, 5)
        terms = D.np.unique([index.terms[w] for w in passage if w in index.terms])
        want = {k: s for k, v in scores.items() if (s := sum(v.get(w, 0) for w in set(passage))) >= index.threshold}
        got = {k: s for _, k, s in index.search(D.np.zeros(len(terms), dtype=int), terms)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        if want:  # a passage over the threshold always has an essential term
            assert (terms <= index.essential).any()
            hits += 1
    assert hits > 30
    assert index.search(D.np.zeros(0, dtype=int), D.np.zeros(0, dtype=int)) == []


def test_query_is_the_definition(spark, make, bench, monkeypatch):
    """All passages of all texts against all items, in one index and in several: rows, scores and overlaps are those of a plain loop."""
    common, items = bench
    items = [*items, (500, " ".join(common[:12])), (501, "single"), (502, items[3][1])]
    rng = random.Random(31)
    rows = []
    for d in range(120):
        own = D.words_of(items[rng.randrange(len(items))][1])
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((d, " ".join(words(rng, rng.randint(0, 200)) + own + rng.choices(common, k=rng.randint(0, 80)))))
    scores, stride = plain_scores(items), max(len(D.words_of(t)) for _, t in items)
    index = index_of(items)
    want = {}
    for d, t in rows:
        ids = [index.terms.get(w, -1) for w in D.words_of(t)]
        for at in range(0, max(1, len(ids) - stride), stride) if len(ids) > stride else [0]:
            here = set(D.words_of(t)[at : at + 2 * stride])
            for j, (i, _) in enumerate(items):
                s = sum(x for w, x in scores[i].items() if w in here)
                if s >= 0.6 and (share := index.verified(j, ids[at : at + 2 * stride], {})) and s > want.get((d, i), (0,))[0] + 1e-9:
                    want[d, i] = (s, *share, at)
    df = spark.createDataFrame(items, "item_id long, text string")
    assert 60 < len(want)
    for most in (D.INDEX_WORDS, 900):
        monkeypatch.setattr(D, "INDEX_WORDS", most)
        assert (sum(1 for _ in D.indexes(df)) > 3) == (most == 900)
        got = {(r.doc_id, r.item_id): r[2:] for r in D.contaminated(make(rows), df).collect()}
        assert got.keys() == want.keys()
        assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k]))


def test_planted_items_are_found(spark, make, bench):
    common, items = bench
    rng = random.Random(9)
    rows, want = [], set()
    for d in range(200):
        text = words(rng, rng.randint(0, 300)) + rng.choices(common, k=60)
        rng.shuffle(text)
        if d % 4 == 0:
            i = rng.randrange(len(items))
            at = rng.randrange(len(text) + 1)
            text[at:at] = items[i][1].upper().split()
            want.add((d, i))
        rows.append((d, " ".join(text)))
    bench_df = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    got = D.contaminated(make(rows), bench_df).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in got)
    left = {r.doc_id for r in D.clean(make(rows), bench_df).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}
    # half an item is none
    half = [(i, " ".join(t.split()[: len(t.split()) // 2])) for i, t in items]
    assert D.contaminated(make(half), bench_df).count() == 0


def test_one_edit_anywhere_is_found(bench):
    """An item with one word replaced, added or dropped at any place, or without its last word, is found where the scores reach the threshold."""
    _, items = bench
    index = index_of(items)
    around = words(random.Random(4), 30)
    for i, t in items[::10]:
        own = t.split()
        for k in range(len(own)):
            for put in (["changedword"], [own[k], "addedword"], []):
                text = " ".join(around + own[:k] + put + own[k + 1 :] + around)
                assert i in {h[0] for h in index.hits([text])[0]}, (i, k, put)


def test_least_edits():
    rng = random.Random(8)
    for _ in range(500):
        part, own = rng.choices(range(4), k=rng.randint(1, 9)), rng.choices(range(5), k=rng.randint(0, 14))
        assert D.least_edits(part, own) == min(distance(part, own[a:b]) for a in range(len(own) + 1) for b in range(a, len(own) + 1))


def test_more_items_than_an_index_holds(spark, make, bench, monkeypatch):
    monkeypatch.setattr(D, "INDEX_WORDS", 1500)
    _, items = bench
    df = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(make(items), df).collect()} >= {(i, i) for i, _ in items}
    assert D.clean(make(items), df).count() == 0


def test_odd_rows(spark, make):
    df = spark.createDataFrame([(1, "same row"), (None, "x")], "item_id long, text string")
    got = D.contaminated(make(ODD), df).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(5, 1), (5, 1)]
    assert D.clean(make(ODD), df).count() == len(ODD) - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(make(ODD), none).count() == 0 and D.clean(make(ODD), none).count() == len(ODD)
    assert D.contaminated(make([]), df).count() == 0


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(5)
    terms = ["".join(rng.choices("abc", k=rng.randint(2, 11))) for _ in range(60)]
    trie = T.Trie(terms)
    found = 0
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        w = "".join(w)
        near = sorted((distance(w, t), t) for t in set(terms) if distance(w, t) <= T.edits(t))
        assert trie.match(w) == (near[0][1] if near else None), (w, near)
        found += bool(near)
    assert found > 2000


def test_quotation():
    text = 'He said "you loser" and left'
    at = text.index("loser")
    assert T.quoted(text, at, at + 5)
    assert T.quoted("« loser »", 2, 7) and T.quoted("the word loser", 9, 14)
    assert not T.quoted("you loser", 4, 9) and not T.quoted('"a" loser "b"', 4, 9)


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_toxicity_held_out(spark, make):
    rng = random.Random(2)
    bad, rows, labels = ["horribleperson", "wretchling", "scumbag"], [], []
    vocab = words(rng, 500)
    for d in range(800):
        text, toxic = rng.choices(vocab, k=rng.randint(5, 60)), int(d % 4 == 0)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice(bad)
                text.insert(rng.randrange(len(text)), w if rng.random() < 0.8 else w[:3] + w[4:])
        rows.append((d, " ".join(text)))
        labels.append((d, toxic, 1))
    table = spark.createDataFrame([*labels, (None, 1, 1), (801, None, 1)], "doc_id long, toxic int, quality int")
    model = T.fit(make(rows), table)
    assert set(bad) <= set(model.hits.trie.terms)
    got = {r.doc_id: r for r in T.score(make([*rows, *((5000 + i, t) for i, (_, t) in enumerate(ODD))]), model).collect()}
    right = [got[d].predicted == t for d, t, _ in labels if held(d)]
    assert sum(right) >= 0.95 * len(right) > 100
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert T.score(make([]), model).count() == 0


def test_toxicity_is_the_definition(spark, make):
    """Scores of the query are those of a plain loop: every word against every term, every hit in its window."""
    import math

    rng = random.Random(14)
    vocab, bad = words(rng, 80), ["wretch", "horribleperson", "scumbagish", "foul"]
    rows, labels = [], []
    for d in range(300):
        text, toxic = rng.choices(vocab, k=rng.randint(2, 40)), int(d % 3 == 0)
        for _ in range(toxic * rng.randint(1, 3)):
            w = rng.choice(bad)
            k = rng.randrange(len(w))
            text.insert(rng.randrange(len(text) + 1), rng.choice([w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], f'said "{w}" then', f"\u00ab {w} \u00bb"]))
        rows.append((d, " ".join(text)))
        labels.append((d, toxic))
    model = T.fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    terms, weights = model.hits.trie.terms, model.weights
    assert set(bad) <= set(terms)

    def plain(text):
        low, count, seen = text.lower(), [0, 0, 0, 0], set()
        found = [*T.WORD.finditer(low)]
        for m in found:
            near = sorted((distance(m[0], t), t) for t in terms if distance(m[0], t) <= T.edits(t))
            if near:
                count[2 * T.quoted(low, m.start(), m.end()) + (near[0][0] > 0)] += 1
                seen.add(near[0][1])
        x = [*count, len(seen), 100 * (count[0] + count[1]) / max(1, len(found)) if seen else 0]
        return 1 / (1 + math.exp(-sum(w * math.log1p(v) for w, v in zip(weights, x)) - weights[-1]))

    got = {r.doc_id: r.score for r in T.score(make(rows), model).collect()}
    assert all(abs(got[d] - plain(t)) < 1e-9 for d, t in rows)


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.score(make(ODD), T.fit(make(ODD), none)).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)


def test_language_held_out(spark, make):
    rng = random.Random(8)
    alphabets = {"aa": "abcdeé", "bb": "abcxyz", "cc": "xyzuvw"}
    vocab = {k: words(rng, 300, a) for k, a in alphabets.items()}
    rows = []
    for d in range(900):
        lang = rng.choice([*alphabets])
        text = rng.choices(vocab[lang], k=rng.randint(3, 40)) + words(rng, 2, alphabets[lang])
        rows.append((d, " ".join(text), lang))
    df = make(rows)
    model = L.fit(df)
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    right = [got[d].lang_pred == lang for d, _, lang in rows if held(d)]
    assert sum(right) >= 0.95 * len(right) > 100
    unseen = L.Model(*model.state()).predict(["uvwuvwu vuwvuw", "édcédc cdééd"])  # words of no sample
    assert [x for x, _ in unseen] == ["cc", "aa"]
    odd = {(r.doc_id, r.lang_pred == "und") for r in L.identify(make(ODD + [(11, "123 --")]), model).collect()}
    assert {d for d, und in odd if und} == {1, 2, 3, 11}
    assert L.identify(make([]), model).count() == 0
    marked = L.annotate(df, model, "p", "s")
    assert marked.columns == [*df.columns, "p", "s"] and marked.where("p = lang").count() >= 850


def plain_language(rows, texts):
    """Language and posterior of each text by the definition, with counts in dictionaries and every language looked up."""
    import math
    import unicodedata
    from collections import Counter

    def split(t):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()

    learn = [(k, split(t)) for d, t, k in rows if not held(d)]
    langs = sorted({k for k, _ in learn})
    words = {k: Counter(w for j, ws in learn if j == k for w in ws) for k in langs}
    grams = {k: Counter() for k in langs}
    for k in langs:
        for w, n in words[k].items():
            for g in L.grams_of(w):
                grams[k][g] += n
    known = {w for w, n in sum(words.values(), Counter()).items() if n >= 2}
    seen = {g for g, n in sum(grams.values(), Counter()).items() if n >= 3 or len(g) == 1}
    total = {k: sum(words[k].values()) + 1 for k in langs}
    mass = {(k, n): sum(c for g, c in grams[k].items() if len(g) == n) + 1 for k in langs for n in range(1, 5)}

    def score(w, k):
        if w in known:
            return math.log((words[k][w] + 0.5) / total[k])
        s, got = f"^{w}$", []
        for end in range(2, len(s) + 1):
            for g in (s[max(0, end - n) : end] for n in (4, 3, 2, 1) if n <= end):
                if g in seen:
                    got.append(math.log((grams[k][g] + 0.5) / mass[k, len(g)]) + (4 - len(g)) * math.log(0.4))
                    break
        return sum(got) / len(got) if got else 0.0

    out = []
    for t in texts:
        of = {k: sum(score(w, k) for w in split(t or "")) for k in langs}
        best = max(langs, key=lambda k: (of[k], [-ord(c) for c in k]))
        out.append((best, 1 / sum(math.exp(max(-700, x - of[best])) for x in of.values())) if split(t or "") else ("und", 0.0))
    return out


def test_language_is_the_definition(spark, make, monkeypatch):
    rng = random.Random(21)
    alphabets = {"aa": "abcdeé", "bb": "abcxyz", "cc": "xyzuvwß", "dd": "abuvд"}
    rows = [(d, " ".join(words(rng, rng.randint(0, 30), alphabets[k]) + rng.choices(["½", "x²y", "12", "Ⅷ", "abc"], k=2)), k) for d, k in ((d, rng.choice([*alphabets])) for d in range(250))]
    model = L.fit(make(rows))
    extra = [(1000 + i, t, None) for i, t in enumerate([None, "", "½", "²³", "①②", "Ⅷ", "12", "q", "qqq日本", "a½b abc"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(make([*rows, *extra]), model).collect()}
    want = plain_language(rows, [t for _, t, _ in rows + extra])
    for (d, _, _), (k, s) in zip(rows + extra, want):
        assert got[d][0] == k and abs(got[d][1] - s) < 1e-9, d
    monkeypatch.setattr(L, "CELLS", 8)  # few texts at once
    again = model.predict([t or "" for _, t, _ in rows + extra])
    assert [k for k, _ in again] == [k for k, _ in want] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(again, want))
    assert [got[1000 + i][0] for i in range(7)] == ["und"] * 7


def test_language_without_labels(spark, make):
    got = L.identify(make(ODD), L.fit(make(ODD))).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}


def test_samples_are_bounded_by_ids(spark, make):
    """One id may hold most rows; it counts once in a sample, and a sample has about as many ids as it says."""
    from glossade.llm.shared import sampled

    rows = [(7, f"hot row {i}", "aa") for i in range(500)] + [(d, f"text {d}", "bb") for d in range(1000, 1600)]
    df = make(rows)
    drawn = sampled(df, 100).select("doc_id").distinct().count()
    assert 60 <= drawn <= 140 and sampled(df, 5000).count() == len(rows)
    model = L.fit(df, rows=5000)
    assert model.langs == ["aa", "bb"] and model.predict(["hot row"])[0][0] == "aa"
    labels = spark.createDataFrame([(d, d % 2) for d, *_ in rows], "doc_id long, toxic int")
    assert T.score(df, T.fit(df, labels)).count() == len(rows)


def test_labels_are_no_input(spark, make):
    rows = [(d, f"word{'a' * (d % 3)} text", "xy"[d % 2]) for d in range(60)]
    a = L.identify(make(rows), m := L.fit(make(rows)))
    b = L.identify(make([(d, t, None) for d, t, _ in rows]), m)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
