"""Incremental counterparts: resumed items and running key counts (an extension; the batch operators stay the definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_SPACE, words
from ..session import scratch
from ..sources.outputs import exists


def running_counts(stream: DataFrame, by: list[str], text: str = "text"):
    """A streaming (or batch) frame of (by..., key, count); as a stream its state is a row a key."""
    return stream.select(*by, F.explode(words(F.lower(text), ASCII_SPACE)).alias("key")).groupBy(*by, "key").agg(F.count("*").alias("count"))


def windowed_counts(stream: DataFrame, ts: str, key: str, length: str = "1 day", late: str = "1 hour"):
    """Counts by event-time window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "key", "count")


def resume(stream: DataFrame, done_path: str, process, checkpoint: str, on: str = "item_id"):
    """Runs process(batch) on items without a record under done_path, appends what it gives there, and remembers where it was in checkpoint."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        left = batch.dropDuplicates([on])
        if there:
            left = left.join(spark.read.parquet(done_path).select(on).distinct(), on, "left_anti")
        process(left).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a bounded streaming frame to its end into files of the shared folder: complete results replace one another, others are added."""
    path, done = scratch(spark, name), scratch(spark, f"{name}-checkpoint")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], df.schema)
