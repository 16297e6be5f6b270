from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexloom.streaming import jobs

START = datetime(2024, 1, 1)


def test_job_queue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", "enqueue", at(0)), ("a", "enqueue", at(1)), ("a", "claim", at(2)), ("a", "fail", at(3)), ("a", "claim", at(4)), ("a", "claim", at(40)), ("a", "done", at(41)), ("b", "claim", at(1)), ("c", "enqueue", at(0)), ("c", "claim", at(1)), ("c", "fail_permanently", at(2))]
    spark.createDataFrame(rows, "job string, action string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/m")
    stream = jobs.read_stream(spark, f"{tmp_path}/m", spark.read.parquet(f"{tmp_path}/m").schema)
    got = {}
    for r in jobs.drained(jobs.processed(stream), "queue_test", "append").collect():
        got.setdefault(r["job"], []).append((r["action"], r["status"], r["attempts"]))
    assert got["a"] == [("enqueue", "queued", 0), ("enqueue", "ignored", 0), ("claim", "running", 1), ("fail", "queued", 1), ("claim", "ignored", 1), ("claim", "running", 2), ("done", "done", 2)]
    assert got["b"] == [("claim", "ignored", 0)]
    assert got["c"][-1] == ("fail_permanently", "failed", 1)


def test_backoff():
    assert [jobs.backoff(n) for n in (1, 2, 3)] == [30, 60, 120]


def test_approximate_medians(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("source"), F.lit(START).alias("discovered_at"), (F.lit(START) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("published_at"), F.lit("done").alias("status"))
    for r in jobs.freshness(rows).collect():
        assert abs(r["p50_hours"] * 60 - 500) <= 3


def test_limit_excludes_the_start_of_its_window(spark):
    rows = spark.createDataFrame([("u", START), ("u", START + timedelta(seconds=60))], "user string, at timestamp")
    assert [r["recent"] for r in jobs.over_limit(rows, "user", "at", 60, 1).orderBy("at").collect()] == [1, 1]
    assert [r["recent"] for r in jobs.over_limit(rows, "user", "at", 61, 1).orderBy("at").collect()] == [1, 2]


def test_medians_of_very_many_jobs_are_exact(spark, tmp_path):
    """A day and source with more jobs than an approximation keeps: the median is a job's own, in a table and in a stream."""
    rows = spark.range(300_001).select(F.lit(1).alias("source"), F.lit(START).alias("discovered_at"), F.timestamp_micros(F.unix_micros(F.lit(START)) + F.pmod(F.col("id") * 7919, F.lit(300_001)) * 1000).alias("published_at"))
    rows.write.parquet(f"{tmp_path}/jobs")
    for table in (rows, jobs.read_stream(spark, f"{tmp_path}/jobs", rows.schema)):
        assert [(round(r["p50_hours"] * 3.6e6, 3), r["published"]) for r in jobs.freshness(table).collect()] == [(150_000, 300_001)]
