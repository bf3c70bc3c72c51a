import json

import pytest

from glossade.operators import halves
from glossade.sources import conll, files

CONLLU = "# sent_id = lost\n1\ta\ta\tNOUN\t_\t_\t0\t_\t_\t_\n\n# NEWDOC id = d1\n# sent_id = s1\n1-2\tdu\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\t_\t_\t0\t_\t_\t_\n2\tle\tle\tDET\t_\t_\t0\t_\t_\t_\n\n1\tx\tx\tX\t_\t_\t0\t_\t_\t_\n"


def test_conllu(spark, tmp_path):
    """Sentences are counted from 0 in each document; what ends before the first document goes."""
    (tmp_path / "a.conllu").write_text(CONLLU)
    conll.register(spark)
    got = spark.read.format("conll").option("layout", "conllu").load(str(tmp_path)).orderBy("sent_no").collect()
    assert [(r.doc_id, r.sent_id, [t.form for t in r.tokens]) for r in got] == [("d1", "s1", ["de", "le"]), ("d1", "sent-1", ["x"])]
    assert [r.sent_id for r in conll.read_store(spark, str(tmp_path), "conllu").orderBy("sent_no").collect()] == ["s1", "sent-1"]


def token_row(n, form):
    return f"{n}\t{form}\t{form}\tX\t_\t_\t0\t_\t_\t_\n"


def test_conllu_documents():
    """Empty documents keep their place, a document ends the sentence before it, only an empty line ends one otherwise, and a document needs an id."""
    read = lambda text: [(no, d, s, [t[0] for t in tokens]) for no, d, s, _, tokens in conll.conllu_sentences(iter(text.splitlines(keepends=True)), "stem", conll.has_documents(iter(text.splitlines())))]
    a, b, c = (token_row(1, x) for x in "abc")
    assert read("# newdoc id = d1\n" + a + "# newdoc id = d2\n# newdoc id = d3\n" + b + "\n" + c) == [(1, "d1", "sent-0", ["a"]), (2, "d2", None, []), (3, "d3", "sent-0", ["b"]), (3, "d3", "sent-1", ["c"])]
    assert read(a + "# newdoc\n" + b + " \n" + c + "\n" + a) == [(1, "stem", "sent-0", ["a", "b", "c"]), (1, "stem", "sent-1", ["a"])]
    assert read("# sent_id = open\n" + a + "# newdoc id = d1\n" + b) == [(1, "d1", "open", ["a", "b"])]  # open when the first document begins
    assert read("# newdoc id = d1\n# sent_id = s\n\n" + a) == [(1, "d1", "s", ["a"])]
    assert read("") == [] and read("# newdoc id = d\n") == [(1, "d", None, [])]


def test_empty_documents_keep_their_place(spark, tmp_path):
    from glossade.operators import pairing

    for name, docs in (("human", ["a", "", "b"]), ("model", ["x", "y", "z"])):
        (tmp_path / f"{name}.conllu").write_text("".join(f"# newdoc id = {name}{k}\n" + (token_row(1, f) + "\n" if f else "") for k, f in enumerate(docs)))
    docs = pairing.documents(conll.read_store(spark, str(tmp_path), "conllu"))
    human, model = (docs.where(f"file like '%{n}.conllu'") for n in ("human", "model"))
    got = pairing.by_place(human, model).orderBy("pair_id").collect()
    assert [([t.form for t in r.h], [t.form for t in r.m]) for r in got] == [(["a"], ["x"]), ([], ["y"]), (["b"], ["z"])]


def test_conllu_round_trip(spark, tmp_path):
    """All ten columns and multi-word tokens are written; the reader gives the words back."""
    tok = "array<struct<form:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string,deps:string,misc:string>>"
    rows = [("f", 0, "s1", "du pain", [("de", "de", "ADP", "P", None, 3, "case", None, "SpaceAfter=No"), ("le", "le", "DET", None, "Number=Sing", 3, "det", None, None), ("pain", None, "NOUN", None, None, 0, "root", "0:root", None)], [(1, 2, "du")])]
    df = spark.createDataFrame(rows, f"file string, sent_no int, sent_id string, text string, tokens {tok}, ranges array<struct<first:int,last:int,form:string>>")
    conll.write(df, str(tmp_path / "out"), "conllu")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt")))
    assert text == "# sent_id = s1\n# text = du pain\n1-2\tdu\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\tP\t_\t3\tcase\t_\tSpaceAfter=No\n2\tle\tle\tDET\t_\tNumber=Sing\t3\tdet\t_\t_\n3\tpain\t_\tNOUN\t_\t_\t0\troot\t0:root\t_\n\n"
    conll.write(df.drop("ranges"), str(tmp_path / "plain"), "conllu")
    assert "1-2" not in "".join(p.read_text() for p in (tmp_path / "plain").glob("part-*.txt"))
    (tmp_path / "again.conllu").write_text(text)
    assert [[t.form for t in r.tokens] for r in conll.read_store(spark, str(tmp_path / "again.conllu"), "conllu").collect()] == [["de", "le", "pain"]]


def test_written_files_are_bounded(spark, tmp_path):
    """However many sentences a task holds, a file (which is one row to the reader) has a bounded number of them, and all come back in order."""
    rows = [("f", i, f"s{i}", "a b", [("a", "a", "X"), (f"b{i}", None, "Y")]) for i in range(25)]
    df = spark.createDataFrame(rows, "file string, sent_no int, sent_id string, text string, tokens array<struct<form:string,lemma:string,upos:string>>").coalesce(1)
    for kind in ("basic", "conllu"):
        conll.write(df, str(tmp_path / kind), kind, most=10)
        assert [p.read_text().count("# sent_id") for p in sorted((tmp_path / kind).glob("part-*.txt"))] == [10, 10, 5]
        got = conll.read_store(spark, str(tmp_path / kind), kind).orderBy("file", "sent_no").collect()
        assert [(r.sent_id, r.sent_no, r.text, [tuple(t) for t in r.tokens]) for r in got] == [(s, i % 10, t, [(f, le if kind == "basic" else le or "_", u) for f, le, u in w]) for _, i, s, t, w in rows]


def test_parts_are_one_file(spark, tmp_path):
    """Documents are counted on from part to part in the order of the numbers that Spark gives them, by folder."""
    from glossade.operators import pairing

    for side in "hm":
        (tmp_path / side).mkdir()
        for name, words in (("part-00002-u-c000.txt", "ef"), ("part-00010-u-c000.txt", "g"), ("part-00002-u-c1000.txt", ""), ("part-00000-u-c002.txt", "b"), ("part-00000-u-c010.txt", "cd"), ("part-00000-u-c000.txt", "a")):
            (tmp_path / side / name).write_text("".join(f"# newdoc id = {w}\n" + token_row(1, w + side) + "\n" for w in words))
    docs = [pairing.parts_joined(pairing.documents(conll.read_store(spark, str(tmp_path / side), "conllu"))) for side in "hm"]
    assert [(r.place, r.doc_id) for r in docs[0].orderBy("place").collect()] == [*enumerate("abcdefg", 1)]
    assert sorted((r.h[0].form, r.m[0].form) for r in pairing.by_place(*docs).collect()) == [(w + "h", w + "m") for w in "abcdefg"]


def test_basic_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "2020.pos").write_text("# sent_id = en-2020-L1-s1\n# text = A b\n1\tA\t_\tDET\n2\tb\tb\tNOUN\n\n# sent_id = e\n# text = c\n1\tc\tc\tX\n")
    conll.register(spark)
    df = spark.read.format("conll").load(str(src))
    first = df.orderBy("sent_no").collect()
    assert first[0].tokens[0].lemma is None and first[1].text == "c"
    conll.write(df.coalesce(1), str(tmp_path / "out"))
    (tmp_path / "again").mkdir()
    body = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt")))
    (tmp_path / "again" / "2020.pos").write_text(body)
    again = spark.read.format("conll").load(str(tmp_path / "again")).orderBy("sent_no").collect()
    assert [(r.sent_id, r.text, r.tokens) for r in again] == [(r.sent_id, r.text, r.tokens) for r in first]


def test_json_modes(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text(json.dumps({"item_id": "a", "lang": "en"}) + "\n{broken\n")
    path = str(p)
    assert [r.item_id for r in files.json_lines(spark, path, files.GENERATION, "drop").select("item_id", "lang").collect() if r.item_id] == ["a"]
    kept = files.json_lines(spark, path, files.GENERATION, "keep").cache()
    assert sorted(r._parse_error for r in kept.collect()) == [False, True]
    with pytest.raises(Exception):
        files.json_lines(spark, path, files.GENERATION).collect()


def test_counts_and_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\t2\nb\tx\na\t3\nc\t1\t9\n")
    assert [tuple(r) for r in files.counts(spark, str(tmp_path / "c.tsv")).collect()] == [("a", 5)]
    (tmp_path / "l.txt").write_text("one\ntwo")
    files.register(spark)
    assert [(r.line_no, r.text) for r in spark.read.format("numbered_lines").load(str(tmp_path / "l.txt")).collect()] == [(1, "one"), (2, "two")]
    assert files.parse_years("2019-2024") == (2019, 2024)
    with pytest.raises(ValueError):
        files.parse_years("2024-2019")


def test_table_keeps_quotes_and_null_words(spark, tmp_path):
    df = spark.createDataFrame([('say "x"', 1.0), ("null", 2.0), ("n/a", 3.0)], "key string, LAS double")
    files.write_table(df, str(tmp_path / "t"))
    assert sorted(r.key for r in files.table(spark, str(tmp_path / "t"), "key string, LAS double").collect()) == ["n/a", "null", 'say "x"']


def test_prompt_config(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("lang_code\tprompt_frame\ttoken_ratio\tverified\nen\tGo on:\\n{}\t1.1\t1\n")
    assert files.prompt_config(spark, str(tmp_path / "p.tsv")).first().prompt_frame == "Go on:\n{}"
    (tmp_path / "q.tsv").write_text("lang_code\tprompt_frame\ttoken_ratio\tverified\nen\tx\t0\t1\n")
    with pytest.raises(ValueError):
        files.prompt_config(spark, str(tmp_path / "q.tsv"))


@pytest.mark.parametrize(
    "text, forms, want",
    [
        ("One two, three four", ["One", "two", ",", "three", "four"], ("strict_alignment", 0, "One two", ", three four")),
        ("One two - three four", ["One", "two", "three", "<gap>"], ("fallback_reconstruction", 0, "One two ", "three <gap>")),
        (None, ["a", "b", ",", "c"], ("fallback_reconstruction", 0, "a b", ", c")),
    ],
)
def test_split_text(text, forms, want):
    idx, method, shift, first, second, _ = halves.split_text(text, forms, "en", 2, 2)
    assert (method, shift, first, second) == want and idx == 2


def test_seam_and_rebuilt():
    forms = "a b c d e f <gap> h i j k l".split()
    assert halves.split_text("a b c d e f g h i j k l", forms, "en", 4, 2)[:2] == (2 + 1, "seam_search") or halves.split_text("a b c d e f g h i j k l", forms, "en", 3, 2)[1] == "seam_search"
    assert halves.rebuilt(["Well", ",", "it", "'", "s", "(", "not", ")", "bad", "."], "en") == "Well, it 's (not) bad."  # an apostrophe that stands alone opens a quote
    assert halves.rebuilt(["l'", "eau", "-", "de", '"', "vie", '"', "."], "fr") == "l'eau-de \"vie\"."
    cases = {
        "en": [("a - b", "a-b"), ("a - b - c", "a-b -c"), ("aa - bb - cc", "aa-bb-cc"), ("- a", "-a"), ("a -", "a-"), ("a - -", "a- -"), ("( - a )", "(- a)"), ('" a " , b', '"a", b'), ('say " x . "', 'say "x. "'), ("( ' a ' )", "(' a ')"), ("l' a' b", "l'a' b"), ("l' ab' b", "l'ab'b"), ("a ! ?", "a!?"), ("x [ y ] { z }", "x [y] { z}"), ("a '. b", "a'. b"), ("", "")],
        "ar": [("و كتب", "وكتب"), ("و ف كتب", "وف كتب"), ("قال و", "قال و")],
        "mr": [("घर ची", "घरची"), ("घर ची त", "घरची त"), ("घर ची त ही", "घरची तही"), ("ची घर", "ची घर"), ("घर ची .", "घर ची.")],
    }
    for lang, pairs in cases.items():
        for given, want in pairs:
            assert halves.rebuilt(given.split(), lang) == want, given
    assert halves.rebuilt(["日", "本"], "ja") == "日本"
    assert halves.seam("x y x y", ["x", "y"], 1) is None


def test_split_halves_frame(spark):
    tok = "array<struct<form:string,lemma:string,upos:string>>"
    rows = [("en-2020-L1-s1", "en", " ".join("abcdefgh"), [(c, c, "X") for c in "abcdefgh"]), ("en-2020-L2-s1", "en", "a b", [("a", "a", "X"), ("b", "b", "X")])]
    r = halves.split_halves(spark.createDataFrame(rows, f"sent_id string, lang string, text string, tokens {tok}"), least=3).collect()
    assert len(r) == 1 and r[0].split_meta["index"] == 4 and r[0].text.first_half == "a b c d" and r[0].id.year == 2020 and r[0].split_meta.is_perfect_reconstruction


def test_long_texts_are_cut_in_proportion(spark):
    """A text of 60,000 words, whose tokens are found in it one after the other, takes no longer a word than a short one; forms that are empty or hold blanks are found as before."""
    import time

    tok = "array<struct<form:string,lemma:string,upos:string>>"
    long_ = [f"wö{k}" for k in range(60_000)]
    texts = [("  ".join(long_), long_), ("a b c d", ["a", "b", "c", "d"]), ("a b c d", ["a", " b", "c", "d"]), ("a  b d", ["a", "", "b", "d"]), ("ab c-d", ["a", "b", "c", "d"])]
    rows = [(f"en-2020-L{k}-s1", "en", t, [(f, f, "X") for f in forms]) for k, (t, forms) in enumerate(texts)]
    df = spark.createDataFrame(rows, f"sent_id string, lang string, text string, tokens {tok}")
    began = time.time()
    got = {r.id.sent_id: r for r in halves.split_halves(df, least=2).collect()}
    assert time.time() - began < 40  # a walk from the start of the text for every word takes minutes
    for sid, lang, text, tokens in rows:
        index, method, shift, first, second, whole = halves.split_text(text, [f for f, _, _ in tokens], lang, len(tokens) // 2, 2)
        r = got[sid]
        assert (r.split_meta["index"], r.split_meta.method, r.split_meta.shift, r.text.first_half, r.text.second_half, r.text.full_inferred) == (index, method, shift, first, second, whole)
