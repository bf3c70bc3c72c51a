"""Scans of column files, file layouts, sinks, tagging and pairing, on small trees."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from glossade.operators import generation, pairing, prevalence, selection, tagging
from glossade.operators import lines as ln
from glossade.sources import columns, conll, files, layout, outputs

POS = "# sent_id = en-2020-L1-s1\n# text = Ab c\n1\tAb\tAb\tNOUN\n2\tc\tЁ\tX\n\n\n# sent_id = s2\n# text = d\n1\td\td\tNOUN\nbad line\n \n1\tz\tz\tNOUN\n# text = two words\n1\ttwo\ttwo\tNUM\n"


@pytest.fixture()
def tree(tmp_path):
    for lang in ("en", "de"):
        (tmp_path / "pos" / lang).mkdir(parents=True)
        (tmp_path / "pos" / lang / "2020.pos").write_text(POS)
    (tmp_path / "pos" / ".hidden").mkdir()
    return str(tmp_path / "pos")


def test_column_scans(spark, tree):
    lines = columns.token_lines(spark, tree).where("lang = 'en'")
    assert lines.first().year == 2020 and lines.count() == 6
    assert sorted(r.key for r in columns.keys(lines).collect()) == ["ab_NOUN", "d_NOUN", "two_NUM", "z_NOUN", "е_X"]
    counts, total = columns.targeted_counts(lines, spark.createDataFrame([("en", "ab_NOUN"), ("en", "ab_NOUN"), ("de", "z_NOUN"), ("en", "no_X")], "lang string, key string"))
    assert [(r.key, r["count"]) for r in counts.collect()] == [("ab_NOUN", 1)] and total.first().total == 6  # the bad line counts
    sizes = lambda loose: sorted(r.token_count for r in columns.sentence_lengths(spark, tree, loose).where("lang = 'de'").collect())
    assert sizes(True) == [2, 2, 2] and sizes(False) == [2, 3]
    texts = columns.texts_with_counts(spark, tree).where("lang = 'en'")
    assert sorted((r.text, r.token_count) for r in texts.collect()) == [("Ab c", 2), ("d", 1), ("two words", 1)]
    r = columns.token_ratios(texts, lambda values: [len(v) for v in values]).first()
    assert (r.files_analyzed, r.sentences_analyzed, r.avg_bpe_per_pos_token, r.min_ratio, r.max_ratio) == (1, 3, 4.0, 1.0, 9.0)
    assert columns.token_ratios(texts.limit(1), lambda values: [1] * len(values)).first().std_dev == 0.0


def test_layout(spark, tree, tmp_path):
    found = layout.listing(spark, tree, "*.pos")
    assert sorted(r.lang for r in layout.languages(found, tree).collect()) == ["de", "en"]
    assert [r.lang for r in layout.languages(found, tree, ["en", "fr"]).collect()] == ["en"]
    with pytest.raises(FileNotFoundError):
        layout.the_file(found)
    assert layout.the_file(found.where("path like '%/en/%'")).endswith("en/2020.pos") and layout.the_file(found, "x") == "x"
    human, model = tmp_path / "h", tmp_path / "m"
    human.mkdir(), model.mkdir()
    for n in ("en_pregenhalves_1.jsonl", "en_pregenhalves_2.jsonl", "fr_pregenhalves_1.jsonl", "other.txt"):
        (human / n).write_text("{}")
    for n in ("en_pregenhalves_2_generations_pos.jsonl", "en_pregenhalves_1_generations_pos.jsonl"):
        (model / n).write_text("{}")
    pairs = {r.lang: r for r in layout.language_pairs(layout.listing(spark, str(human)), layout.listing(spark, str(model))).collect()}
    assert pairs["en"].human.endswith("_1.jsonl") and pairs["en"].model.endswith("_1_generations_pos.jsonl") and pairs["fr"].model is None
    assert {r.lang: r.path[-7:] for r in layout.by_language(layout.listing(spark, str(human))).collect()} == {"en": "2.jsonl", "fr": "1.jsonl"}
    data = tmp_path / "data" / "news" / "las-m-2024-01-02x" / "k12"
    data.mkdir(parents=True)
    for n in ("las_word_en.csv", "summary_en.json", "las_word_de.csv"):
        (data / n).write_text("x")
    r = layout.word_tables(layout.listing(spark, str(tmp_path / "data")), str(tmp_path / "data")).collect()
    assert [(x.lang, x.register, x.model) for x in r] == [("en", "news", "las-m-2024-01-02x")]


def test_links_and_manifest(spark, tmp_path):
    html = '<a href="en/">en</a><a href="../">up</a><a href="news.2019.en.shuffled.deduped.gz">x</a> news.2019.en.shuffled.deduped.gz'
    pages = spark.createDataFrame([(html,), (None,)], "html string")
    assert [tuple(r) for r in layout.news_links(pages).collect()] == [("news.2019.en.shuffled.deduped.gz", 2019, "en")]
    assert [r.lang for r in layout.folder_links(pages).collect()] == ["en"]
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "2020.txt").write_text("one\ntwo")
    (tmp_path / "en" / "2021.txt").write_text("x\n\n")
    got = {r.year: r for r in layout.manifest(spark, str(tmp_path)).collect()}
    assert (got[2020].lang, got[2020].bytes, got[2020].lines, got[2020].sha256) == ("en", 7, 2, hashlib.sha256(b"one\ntwo").hexdigest()) and got[2021].lines == 2
    outputs.append_rows(layout.manifest(spark, str(tmp_path)), str(tmp_path / "log"))
    outputs.append_rows(layout.manifest(spark, str(tmp_path)), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4


def test_manifest_of_parts(spark, tmp_path):
    """Parts are joined by number, whatever the length of the number; lines and blocks of 64 bytes run over their ends."""
    parts = {"part-00002-a.c000.txt": "one\ntw", "part-00002-a.c999.txt": "o\n" * 50, "part-00002-a.c1000.txt": "x" * 200, "part-100000-a-c000.txt": "\n\nend", "part-99999-a-c000.txt": "é\r\n"}
    order = ["part-00002-a.c000.txt", "part-00002-a.c999.txt", "part-00002-a.c1000.txt", "part-99999-a-c000.txt", "part-100000-a-c000.txt"]
    for folder, names in (("lang=en", order), ("lang=[d]e*", order[3:4]), ("plain", ["b.txt", "a.txt"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(parts.get(n, n).encode())
    (tmp_path / "plain" / "other.csv").write_text("not a part")
    got = {r.lang: (r.bytes, r.lines, r.sha256) for r in layout.manifest_of_parts(spark, str(tmp_path)).collect()}
    told = lambda body, lines: (len(body), lines, hashlib.sha256(body).hexdigest())
    assert got == {"lang=en": told("".join(parts[n] for n in order).encode(), 55), "lang=[d]e*": told("é\r\n".encode(), 1), "plain": told(b"a.txtb.txt", 1)}
    assert layout.manifest_of_parts(spark, str(tmp_path), "*.none").collect() == []


def test_a_language_is_hashed_in_parts(spark, tmp_path, monkeypatch):
    """io_manifest writes no language as one file, and its rows are those of its SQL: odd rows too."""
    import duckdb

    from glossade.plans import files as plan
    from glossade.plans import registry

    own = [(k * 7 % 400, "en" if k % 5 else "de", "web1", f"{k}\r line\n\nand {'é' * (k % 90)}") for k in range(400)]
    own += [(None, "en", "web1", "no number"), (-1, "en", "web1", None), (401, "fr", "web1", ""), (402, "es", "web1", None), (403, None, "web1", "no language"), (404, "a/b +%2B", "web1", "odd")]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(own, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    monkeypatch.setattr(plan, "_PART", 4096, raising=False)
    spark.createDataFrame([], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    runs = itertools.count(1)
    monkeypatch.setattr(plan, "scratch", lambda spark, what: f"file://{tmp_path}/{what}-{next(runs)}")
    got = registry.queries()["io_manifest"](spark, str(tmp_path / "sf")).select("lang", "bytes", "lines", "sha256").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/sf/documents.parquet/*.parquet')")
    want = con.sql(f"select lang, bytes, lines, sha256 from ({registry.oracle_sql()['io_manifest']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert registry.queries()["io_manifest"](spark, str(tmp_path / "none")).collect() == []
    sizes = [p.stat().st_size for p in (tmp_path / "manifest-1" / "lang=en").glob("*.txt")]
    assert sum(sizes) > 4 * 4096 and max(sizes) < 3 * 4096


def test_filtered_lines_and_shards(spark, tmp_path):
    df = spark.createDataFrame([("en", 2020, "a.txt", n, "x" * n if n % 2 else "y\tz") for n in range(1, 9)], "lang string, year int, file string, line_no int, text string")
    outputs.write_filtered(ln.kept(ln.measured(df), chars=5), str(tmp_path / "kept"), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "kept")).collect()] == ["x", "y\tz", "xxx", "y\tz", "xxxxx", "y\tz", "y\tz"]
    log = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "log")).collect()
    assert [(r.line_number, r.line_content) for r in log] == [("7", "x" * 7)]
    outputs.write_shards(df.coalesce(1), str(tmp_path / "shards"), rows=3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 8 and len([*(tmp_path / "shards").glob("lang=en/year=2020/*.parquet")]) == 3


def test_generations_are_asked_for_once(spark, tmp_path):
    asked = []

    def process(left):
        asked.extend(r.item_id for r in left.collect())
        return left.selectExpr("item_id", "'en' as lang", "1 as num_attempts", "2 as input_tokens", "3 as output_tokens")

    path = str(tmp_path / "done")
    requests = lambda *ids: spark.createDataFrame([(i,) for i in ids], "item_id string")
    outputs.append_generations(requests("a", "b", "b"), path, process)
    got = outputs.append_generations(requests("b", "c"), path, process)
    assert sorted(asked) == ["a", "b", "c"] and sorted(r.item_id for r in got.collect()) == ["a", "b", "c"]
    told = json.loads(outputs.run_summary(got, {"model": "m"}).first().json)
    assert told["parameters"] == {"model": "m"} and told["totals"]["output_tokens"] == 9 and told["languages"][0]["items"] == 3
    assert {r.lang: r["items"] for r in generation.run_stats(got).collect()} == {"en": 3, None: 3}
    outputs.write_spot_check(spark.createDataFrame([("a", " b\n c ")], "item_id string, continuation string"), str(tmp_path / "spot"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "spot")).first().continuation == "b c"


def test_tagging(spark):
    def picky(texts, lang):
        if any("boom" in t for t in texts):
            raise RuntimeError("bad text")
        return tagging.rule_tagger(texts, lang)

    df = spark.createDataFrame([("en", "2020", 1, " A b. "), ("en", "2020", 2, " "), ("en", "2020", 3, "boom"), ("de", "2020", 1, "x" * 50), ("de", "2020", 2, "7 !")], "lang string, year string, line_no int, text string")
    got = tagging.tag_lines(df, picky, longest=40).cache()
    fine = {r.sent_id: [tuple(t) for t in r.tokens] for r in got.where("error is null").collect()}
    assert fine == {"en-2020-L1-s1": [("A", "a", "WORD"), ("b.", "b.", "WORD")], "de-2020-L2-s1": [("7", "7", "NUM"), ("!", "!", "PUNCT")]}
    assert sorted((r.lang, r.line_no, r.text_len, r.error) for r in tagging.bad_lines(got).collect()) == [("de", 1, 50, "too_long"), ("en", 3, 4, "RuntimeError: bad text")]
    assert {r.lang: (r.lines, r.sentences, r.tokens, r.failed) for r in tagging.progress(got).collect()} == {"en": (2, 1, 2, 1), "de": (2, 1, 2, 1)}
    records = spark.createDataFrame([("a", "en", ("B c",)), ("b", "en", (None,)), ("c", "en", ("boom",)), ("d", None, ("  ",)), ("e", "en", ("y" * 50,))], "item_id string, lang string, output struct<ai_continuation:string>")
    got = {r.item_id: [tuple(t) for t in r.parse_ai] for r in tagging.tag_continuations(records, picky, longest=40).collect()}
    assert got == {"a": [("b", "WORD"), ("c", "WORD")], "b": [], "c": [], "d": [], "e": []}


def test_generator_is_tried_again(spark):
    def generate(rows):
        import os
        import tempfile

        mark = os.path.join(tempfile.gettempdir(), f"tried-{os.getppid()}-{rows[0]['item_id']}")
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("busy")
        os.remove(mark)
        return [{"item_id": r["item_id"], "text": r["user_prompt"].upper()} for r in rows]

    requests = spark.createDataFrame([("a", "go on")], "item_id string, user_prompt string")
    got = generation.continue_texts(requests.coalesce(1), generate, "item_id string, text string", attempts=2, per_minute=6000)
    assert [tuple(r) for r in got.collect()] == [("a", "GO ON")]


def test_names(spark):
    df = spark.createDataFrame([("en",), ("xx",)], "lang string")
    assert sorted(r.display_name for r in selection.with_names(df, "lang", {"en": "English"}).collect()) == ["English", "xx"]


def test_embeddings_are_computed_once(spark, tmp_path):
    store = str(tmp_path / "store")
    words = lambda *x: spark.createDataFrame([("en", w) for w in x], "lang string, lemma string")
    assert tagging.with_embeddings(words("a", "b", "b"), lambda t: [[1.0] for _ in t], store).count() == 2
    got = {r.lemma: r.embedding for r in tagging.with_embeddings(words("b", "c"), lambda t: [[2.0] for _ in t], store).collect()}
    assert got == {"b": [1.0], "c": [2.0]}


def test_pairs_by_item(spark):
    tok = "array<struct<form:string,lemma:string,pos:string>>"
    halves = spark.createDataFrame([(("en", "i1"), (None, [("F", "f", "X"), (None, "g", "Y")])), (("en", "i2"), (None, []))], f"id struct<lang:string,sent_id:string>, parse struct<first_half:{tok},second_half:{tok}>")
    gens = spark.createDataFrame([("i1", [("h", "X")]), ("i1", [("h", "X")]), ("i3", []), (None, [])], "item_id string, parse_ai array<struct<lemma:string,pos:string>>")
    got = pairing.by_item(halves, gens).orderBy("pair_id").collect()
    assert [r.pair_id for r in got] == ["i1#1", "i1#2"]
    assert [tuple(t) for t in got[0].h] == [("F", "f", "X"), ("g", "g", "Y")] and [tuple(t) for t in got[1].m] == [("h", "h", "X")]


def test_pairs_by_place(spark, tmp_path):
    row = lambda w: f"1\t{w}\t{w}\tX\t_\t_\t0\t_\t_\t_\n"
    doc = lambda *w: "# newdoc id = d\n" + "".join(row(x) + "\n" for x in w)
    for name, text in (("h", doc("a", "b") + doc("c")), ("m1", doc("x") + doc("y") + doc("z")), ("m2", doc("q", "r"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.conllu").write_text(text)
    docs = lambda *names: pairing.documents(conll.read_store(spark, [str(tmp_path / n) for n in names], "conllu"))
    got = pairing.by_place(docs("h"), docs("m1", "m2").withColumn("file", F.regexp_extract("file", r"([^/]+)\.conllu", 1)), "file")
    assert sorted((r.model, "".join(t.form for t in r.h), "".join(t.form for t in r.m)) for r in got.collect()) == [("m1", "ab", "x"), ("m1", "c", "y"), ("m2", "ab", "qr")]
    table = prevalence.wlas(got, ("model",), k=1)
    assert {(r.model, r.n_pairs) for r in table.collect()} == {("m1", 2), ("m2", 1)}
    assert prevalence.micro(table).count() >= 4 and files.variants(docs("m1", "m2").select("file").distinct()).count() == 2


def test_halves_round_trip(spark, tmp_path):
    from glossade.operators import halves

    tok = "array<struct<form:string,lemma:string,upos:string>>"
    rows = [(f"en-2020-L{i}-s1", "en", " ".join("abcdefgh"), [(c, c, "X") for c in "abcdefgh"]) for i in range(3)]
    items = halves.split_halves(spark.createDataFrame(rows, f"sent_id string, lang string, text string, tokens {tok}"), least=3)
    outputs.write_halves(items, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [r.id.sent_id for r in got] == [f"en-2020-L{i}-s1" for i in range(3)] and got[0].lang == "en"


def test_scans_run_no_pattern_for_the_path_of_a_line(spark, tree, capsys):
    """Language and file come with every line, so they are cut without a pattern, and white space is stripped without one."""
    columns.keys(columns.token_lines(spark, tree)).groupBy("lang", "key").count().explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    assert "regexp" not in plan
    from glossade.functions.text import strip_space

    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    given = [spaces + "a" + spaces + "b" + spaces, spaces, "", "x", "\u200bx\u200b", None]
    got = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").select("i", strip_space(F.col("g")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [g if g is None else g.strip() for g in given]
