"""Line, JSON-lines, count, table and prompt-config files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GENERATION = (
    "item_id string, lang string, source string, input struct<first_half:string,user_prompt:string,system_prompt:string>, "
    "output struct<ai_continuation:string,full_with_ai:string>, generation string, parse_ai array<struct<lemma:string,pos:string>>"
)
_TOKEN = "array<struct<form:string,lemma:string,pos:string>>"
HALVES = (
    "id struct<lang:string,year:int,file:string,sent_id:string,doc_id:string,sent_idx:int>, "
    "metrics struct<n_tokens_full:int,n_tokens_first:int,n_tokens_second:int,char_len_full:int,char_len_first:int,char_len_second:int>, "
    "split_meta struct<index:int,method:string,shift:int,is_perfect_reconstruction:boolean>, "
    "text struct<full_original:string,full_inferred:string,first_half:string,second_half:string>, "
    f"parse struct<first_half:{_TOKEN},second_half:{_TOKEN}>"
)
WLAS = (
    "rank_LAS int, rank_LPR int, key string, lemma string, form string, upos string, n_pairs int, c_H double, c_M double, ell_H double, ell_M double, "
    "Delta_MH double, LAS double, pp_MH double, relpct_MH double, ell_ratio_MH double, count_ratio_MH double, lpr_MH double, lpr_guard_ok int, lpr_MH_guarded double"
)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Lines(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        return [_Part(p) for p in sorted(glob.glob(os.path.join(self.path, "**", "*.txt"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path))]

    def read(self, partition):
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for n, line in enumerate(f, 1):
                yield partition.path, n, line.rstrip("\n")


class NumberedLines(DataSource):
    """spark.read.format("numbered_lines").load(path): (file, line_no from 1, text), a file a partition."""

    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return "file string, line_no long, text string"

    def reader(self, schema):
        return _Lines(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumberedLines)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lang, year, file, text) of {lang}/{year}.txt, from any store; lines have no numbers here."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path, recursiveFileLookup=True).select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("lang"), F.regexp_extract(file, r"(\d{4})[^/]*$", 1).try_cast("int").alias("year"), file.alias("file"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """strict fails on a bad line, keep gives it as raw_line with _parse_error, drop leaves it out."""
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if mode == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if mode != "keep":
        raise ValueError(f"unknown mode {mode}")
    got = spark.read.schema(schema + ", raw_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw_line").json(path)
    return got.withColumn("_parse_error", F.col("raw_line").isNotNull())


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(key, count) of key<TAB>count files: exactly two fields and a whole number, repeated keys summed."""
    p = F.split("value", "\t", -1)
    own = spark.read.text(path).where(F.size(p) == 2).select(p[0].alias("key"), F.trim(p[1]).try_cast("long").alias("count"))
    return own.where("count is not null").groupBy("key").agg(F.sum("count").alias("count"))


def write_counts(df: DataFrame, path: str) -> None:
    """Most frequent first, ties by key."""
    df.orderBy(F.desc("count"), "key").select(F.concat_ws("\t", "key", F.col("count").cast("string")).alias("value")).write.text(path)


def table(spark: SparkSession, path: str, schema: str = WLAS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    w = df.write.option("header", True).option("escape", '"')
    (w.partitionBy(*by) if by else w).csv(path)


def prompt_config(spark: SparkSession, path: str) -> DataFrame:
    """(lang_code, prompt_frame, token_ratio, verified) with written-out line ends restored; a ratio that is not positive is an error."""
    got = spark.read.schema("lang_code string, prompt_frame string, token_ratio double, verified int").option("header", True).option("sep", "\t").option("quote", "").csv(path)
    got = got.withColumn("prompt_frame", F.replace("prompt_frame", F.lit("\\n"), F.lit("\n")))
    if not got.where("token_ratio is null or token_ratio <= 0 or lang_code is null").isEmpty():
        raise ValueError("token_ratio must be positive and lang_code given")
    return got


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(file, size_bytes, line_count); a last line without an end counts."""
    m = F.col("_metadata")
    return spark.read.text(path, recursiveFileLookup=True).groupBy(m["file_path"].alias("file"), m["file_size"].alias("size_bytes")).agg(F.count("*").alias("line_count"))


def parse_years(text: str) -> tuple[int, int]:
    """2019 or 2019-2024 as first and last year."""
    a, _, b = text.partition("-")
    first, last = int(a), int(b or a)
    if last < first:
        raise ValueError("years run backwards")
    return first, last


def variants(names: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(file, variant): the first label whose pattern is found, else instruct or base, else the file's stem; repeats get -2, -3."""
    from pyspark.sql import Window

    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    out = F.when(F.lower(stem).contains("instruct"), "instruct").when(F.lower(stem).contains("base"), "base").otherwise(stem)
    for label, pattern in reversed((labels or {}).items()):
        out = F.when(stem.rlike(pattern), label).otherwise(out)
    own = names.select("file", out.alias("v"))
    n = F.row_number().over(Window.partitionBy("v").orderBy("file"))
    return own.select("file", F.when(n == 1, F.col("v")).otherwise(F.concat("v", F.lit("-"), n.cast("string"))).alias("variant"))
