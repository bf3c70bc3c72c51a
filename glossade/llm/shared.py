"""What the operators of this subpackage share: the shared folder, written tables, and Arrow batches of texts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def new_path(spark: SparkSession, what: str) -> str:
    return scratch(spark, what)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: it cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossade_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_glossade_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps; it notices only when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty string; columns of other names can't clash with what the operators add."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name and underscores if df has such a column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_of(col: str = "doc_id"):
    """crc32 of the id as text modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(5))


def sampled(df: DataFrame, ids: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of about so many different ids (all, if there are no more), drawn by a hash of the id; one pass counts ids by a sketch, nothing is sorted."""
    n = df.agg(F.approx_count_distinct(id_col, 0.02)).first()[0]
    return df if n <= ids else df.where(F.xxhash64(id_col) < F.lit(int(ids / n * (1 << 64)) - (1 << 63)))


#: Rows go through Python in pieces of at most this many characters (a longer text is a piece of its own).
PIECE_CHARS = 1_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches, cut so that no piece has much more than PIECE_CHARS of text, each with its texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        at = 0
        values: list[str] = []
        size = 0
        for i in range(batch.num_rows):
            v = col[i].as_py() or ""
            values.append(v)
            size += len(v)
            if size >= PIECE_CHARS:
                yield batch.slice(at, i + 1 - at), values
                at, values, size = i + 1, [], 0
        if values:
            yield batch.slice(at), values


def in_pieces(values: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of not much more than PIECE_CHARS characters."""
    held: list[str] = []
    size = 0
    for v in values:
        held.append(v)
        size += len(v)
        if size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over pieces; f may give one batch or several."""

    def run(batches):
        for batch, values in pieces(batches):
            out = f(batch, values)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)
