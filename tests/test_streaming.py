from pyspark.sql import functions as F

from glossade.streaming import incremental


def test_resume_skips_finished_items(spark, tmp_path):
    src, done, check = (str(tmp_path / x) for x in ("src", "done", "check"))
    spark.createDataFrame([("a",), ("b",)], "item_id string").write.parquet(src)
    spark.createDataFrame([("a", 1)], "item_id string, n int").write.parquet(done)
    stream = lambda: spark.readStream.schema("item_id string").parquet(src)
    run = lambda: incremental.resume(stream(), done, lambda b: b.withColumn("n", F.lit(2)), check).awaitTermination()
    run()
    spark.createDataFrame([("b",), ("c",)], "item_id string").write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(done).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("en", "A b a"), ("de", "a")], "lang string, text string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("lang string, text string").parquet(str(tmp_path / "s"))
    got = incremental.drained(spark, incremental.running_counts(stream, ["lang"]), "running", "complete")
    assert sorted(tuple(r) for r in got.collect()) == [("de", "a", 1), ("en", "a", 2), ("en", "b", 1)]
