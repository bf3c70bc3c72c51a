"""Pairs of human and model texts: by item, or by the documents' places in their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tokens(parse: Column, form: bool) -> Column:
    """(form, lemma, upos) of (form, lemma, pos) or (lemma, pos) tokens; a missing form is the lemma."""
    lemma = lambda t: F.coalesce(t["lemma"], F.lit(""))
    return F.transform(parse, lambda t: F.struct((F.coalesce(t["form"], lemma(t)) if form else lemma(t)).alias("form"), lemma(t).alias("lemma"), F.coalesce(t["pos"], F.lit("")).alias("upos")))


def by_item(halves: DataFrame, generations: DataFrame, order: str | None = None) -> DataFrame:
    """(pair_id, item_id, lang, h, m): second halves and tagged generations of one item.

    An item with several generations is several pairs of the same human tokens. Of halves that share an id the last in order (else the greatest)
    counts. Items without a counterpart, and generations that could not be parsed, are left out.
    """
    second = _tokens(F.col("parse.second_half"), True)
    one = F.max_by(second, F.col(order)) if order else F.max(second)
    human = halves.groupBy(F.col("id.sent_id").alias("item_id")).agg(one.alias("h"), F.max("id.lang").alias("lang"))
    model = generations.where("item_id is not null").select("item_id", _tokens(F.col("parse_ai"), False).alias("m"))
    n = F.row_number().over(Window.partitionBy("item_id").orderBy(F.to_json("m")))  # equal generations are interchangeable
    model = model.withColumn("pair_id", F.concat_ws("#", "item_id", n))
    return model.join(human, "item_id").select("pair_id", "item_id", "lang", "h", F.coalesce("m", F.array().cast("array<struct<form:string,lemma:string,upos:string>>")).alias("m"))


def documents(sentences: DataFrame, file: str = "file") -> DataFrame:
    """(file, place, doc_id, tokens): a file's documents from 1, sentences put together in order; one without sentences keeps its place. sentences: as the column source gives them."""
    own = sentences.groupBy(F.col(file).alias("file"), F.col("doc_no").alias("place")).agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("sent_no", "tokens"))).alias("s"))
    return own.select("file", "place", "doc_id", F.flatten(F.col("s.tokens")).alias("tokens"))


def parts_joined(docs: DataFrame) -> DataFrame:
    """documents() of files that are the parts of one: each folder counts as a file, and places go on from part to part in the order of their names (of their numbers, where Spark wrote them)."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("file", r"/part-(\d+-.*-c\d+)[^/]*$", 1), F.lit(r"^(\d+)-|-c(\d+)$"), F.lit(0)), lambda x: F.regexp_extract(x, r"\d+", 0).cast("long"))
    folder = F.regexp_extract("file", "^(.*)/", 1)
    sizes = docs.groupBy("file").agg(F.max("place").alias("n"))  # a row a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("folder").orderBy("numbers", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = docs.join(sizes.withColumns({"folder": folder, "numbers": numbers}).select("file", "folder", before.alias("before")), "file")
    return own.select(F.col("folder").alias("file"), (F.col("before") + F.col("place")).alias("place"), "doc_id", "tokens")


def by_place(human: DataFrame, model: DataFrame, label: str = "file") -> DataFrame:
    """(model, pair_id, h, m): the n-th human document with the n-th of each model file; what the shorter side lacks is left out.

    human: documents() of one file; model: documents() of any number of files, told apart by label.
    """
    a = human.select("place", F.col("tokens").alias("h"))
    b = model.select(F.col(label).alias("model"), "place", F.col("tokens").alias("m"))
    return b.join(a, "place").select("model", F.concat_ws("#", "model", "place").alias("pair_id"), "h", "m")
