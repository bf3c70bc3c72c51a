"""Sinks: kept and dropped lines, shards, halves, generations with resume, summaries, spot checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_filtered(lines: DataFrame, kept_path: str, log_path: str) -> None:
    """lines (lang, file, line_no, char_len, token_count, text, keep): kept texts by language and file, in order, and the dropped ones as a log with tabs written out.

    Only the column keep tells the two apart: lines are read twice rather than held.
    """
    own = lines.where("keep").repartition("lang", "file").sortWithinPartitions("lang", "file", "line_no")
    own.select("lang", "file", F.col("text").alias("value")).write.partitionBy("lang", "file").text(kept_path)
    log = lines.where("not keep").select(F.col("lang").alias("language"), F.col("file").alias("filename"), F.col("line_no").alias("line_number"), "char_len", "token_count", F.replace("text", F.lit("\t"), F.lit("\\t")).alias("line_content"))
    log.write.option("sep", "\t").option("header", True).option("quote", "").csv(log_path)


def write_shards(lines: DataFrame, path: str, rows: int = 200_000) -> None:
    """Parquet by language and year, at most so many rows a file."""
    lines.write.partitionBy("lang", "year").option("maxRecordsPerFile", rows).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """More rows of a manifest or log, as CSV with a header."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_halves(items: DataFrame, path: str) -> None:
    """Split halves as JSON lines by language, in order of year, file and the sentence's number, as far as these are given; the id decides between equals."""
    order = [F.col(f"id.{c}") for c in ("year", "file", "sent_idx", "sent_id") if c in items.schema["id"].dataType.names]
    own = items.withColumn("lang", F.col("id.lang"))
    own.repartition("lang").sortWithinPartitions("lang", *order).write.partitionBy("lang").json(path)


def append_generations(requests: DataFrame, done_path: str, process, on: str = "item_id") -> DataFrame:
    """Runs process(requests without a record under done_path), appends its records there as JSON lines, and gives back all records.

    A run that broke off is taken up by calling again: what was committed is not asked for twice.
    """
    spark = requests.sparkSession
    left = requests.dropDuplicates([on])
    if exists(spark, done_path):
        left = left.join(spark.read.json(done_path).select(on).distinct(), on, "left_anti")
    made = process(left)
    made.write.mode("append").json(done_path)
    return spark.read.schema(made.schema).json(done_path)


def run_summary(records: DataFrame, parameters: dict, prompt: str | None = None) -> DataFrame:
    """One row, json: parameters (with the prompt's sha256, if there is one), totals over all records, and by language. records: as generation.run_stats() reads them."""
    if prompt is not None:
        parameters = parameters | {"prompt_sha256": hashlib.sha256(prompt.encode()).hexdigest()}
    cols = ("items", "requests", "input_tokens", "output_tokens")
    by = records.groupBy("lang").agg(F.count("*").alias("items"), F.sum("num_attempts").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    told = F.struct(*(F.lit(v).alias(k) for k, v in parameters.items())) if parameters else F.struct(F.lit(None).alias("none"))
    totals = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols), F.array_sort(F.collect_list(F.struct("lang", *cols))).alias("languages"))  # a row a language
    return totals.select(F.to_json(F.struct(told.alias("parameters"), F.struct(*cols).alias("totals"), "languages")).alias("json"))


def table_summary(table: DataFrame, quality: DataFrame, score: DataFrame, parameters: dict, top: int = 20) -> DataFrame:
    """One row, json, of a discovery run: parameters, its quality row, its score row, and the best `top` keys."""
    best = table.where(F.col("rank_LAS") <= top).agg(F.array_sort(F.collect_list(F.struct("rank_LAS", "key", "LAS"))).alias("top"))
    told = F.struct(*(F.lit(v).alias(k) for k, v in parameters.items())).alias("params")
    own = quality.select(F.struct(*quality.columns).alias("qc")).crossJoin(score.select(F.struct(*score.columns).alias("score"))).crossJoin(best)  # a row each
    return own.select(F.to_json(F.struct(told, "qc", "score", "top")).alias("json"))


def write_json_text(df: DataFrame, path: str) -> None:
    """The one column json as it is, a file a partition."""
    df.select(F.col("json").alias("value")).write.text(path)


def write_spot_check(rows: DataFrame, path: str) -> None:
    """item_id and continuation in one tab-separated line each, white space folded."""
    from ..functions.text import fold_space

    rows.select("item_id", fold_space(F.col("continuation")).alias("continuation")).write.option("sep", "\t").option("header", True).csv(path)
