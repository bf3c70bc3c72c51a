"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns rows with the columns of documents, the last one
pieces of token sequences. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossade.llm import decontaminate, language, packing, repeats, similar
from glossade.llm.queries import vocabulary
from glossade.llm.shared import new_path, unused
from glossade.session import ship

#: The least posterior of a predicted language that is kept.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (und) or without a clear language; lang becomes the prediction. The model is fitted on docs itself.

    Where no row has a language to learn from, nothing can be rejected but documents without a letter.
    """
    ship(spark)
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    kept = language.annotate(docs, model, pred, score).where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.select(*(F.col(pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, a similarity of 0.8 or more): that of the least doc_id.

    Close copies meet by SimHash blocks, the rest by a prefix filter, and links are verified (see similar.py). Null and empty texts are copies of one
    another; of rows that share a doc_id the first by text stays, if any does; rows without a doc_id stay. No rows give none.
    """
    ship(spark)
    return similar.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that start earlier in the corpus; documents of which nothing but white space is left go. n_chars follows the text.

    A character that a cut divides goes with it.
    """
    ship(spark)
    return repeats.trimmed(docs).where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found. Null and empty texts stay, as does everything where there are no items; rows that repeat share their fate."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of powers of two, a row a piece. A null or empty text is the closing id alone; rows that repeat are packed each; no rows give none."""
    ship(spark)
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: No stage but the last could be said in SQL, and that one needs the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
