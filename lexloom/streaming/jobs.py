"""Queues, limits and reports over streams. Each takes a streaming or a static DataFrame with a timestamp column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder

#: Seconds of a lease, of the first retry's delay, and how often a job is tried.
LEASE, RETRY, ATTEMPTS = 600, 30, 3
#: Rows of a file of a stream's step.
STEP_ROWS = 250_000


def daily(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """Jobs by source and day; days are final once the watermark has passed them."""
    rows = jobs.withWatermark("discovered_at", late) if jobs.isStreaming else jobs
    return rows.groupBy("source", F.window("discovered_at", "1 day").alias("w")).agg(F.count("*").alias("discovered"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed")).select("source", F.to_date("w.start").alias("day"), "discovered", "failed")


def durations(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """(source, day, took, n): how many jobs of a source and day took so many microseconds from discovery to publication.

    A stream's state has a row for each different duration, so quantiles of any number of jobs are exact and no group is held whole.
    """
    rows = jobs.withWatermark("discovered_at", late) if jobs.isStreaming else jobs
    took = F.unix_micros(F.col("published_at").cast("timestamp")) - F.unix_micros(F.col("discovered_at").cast("timestamp"))
    counts = rows.where("published_at is not null").groupBy("source", F.window("discovered_at", "1 day").alias("w"), took.alias("took")).agg(F.count("*").alias("n"))
    return counts.select("source", F.to_date("w.start").alias("day"), "took", "n")


def quantiles(counts: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """(keys, published, pNN_hours ...) of counted durations: the least that so many percent of the jobs do not exceed, exactly."""
    own = Window.partitionBy(*keys)
    rows = counts.withColumn("upto__", F.sum("n").over(own.orderBy("took").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all__", F.sum("n").over(own))
    at = lambda p: F.min(F.when(F.col("upto__") * 100 >= F.col("all__") * p, F.col("took"))) / 3.6e9
    return rows.groupBy(*keys).agg(F.sum("n").alias("published"), *[at(p).alias(f"p{p}_hours") for p in percents])


def freshness(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """The median hours from discovery to publication by source and day; a stream is drained to its durations first."""
    counts = drained(durations(jobs, late), "durations") if jobs.isStreaming else durations(jobs)
    return quantiles(counts, ["source", "day"], [50]).select("source", "day", "p50_hours", "published")


def first_by_key(queue: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """One job for each idempotency key: the first within the watermark of a stream, the earliest of a table."""
    if queue.isStreaming:
        return queue.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    order = Window.partitionBy(*keys).orderBy(at, "event_id")
    return queue.withColumn("n__", F.row_number().over(order)).where("n__ = 1").drop("n__")


def over_limit(failures: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Failures with the number of the key's failures in the window that ends with them (its start is outside it)."""
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy(stamp).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return failures.withColumn("recent", F.count("*").over(recent)).withColumn("blocked", F.col("recent") > most)


def sessions(beats: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of heartbeats without a gap of `gap` or more."""
    rows = beats.withWatermark(at, late) if beats.isStreaming else beats
    return rows.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("beats")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "beats")


def backoff(attempt: int, base: int = RETRY) -> int:
    """Seconds before the next try after the attempt-th failure."""
    return base * 2 ** (attempt - 1)


class JobQueue(StatefulProcessor):
    """The state of each job: messages in (enqueue, claim, done, fail), and what became of it out.

    A claim starts a lease with a timer; a lease that ends returns the job to the queue, or fails it when it was its last
    attempt. A failure waits for its back-off and is queued again, up to ATTEMPTS tries; permanent failures are not.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, ready_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for message in pd.concat(list(rows)).sort_values("at").itertuples():
            now = int(message.at.timestamp() * 1000)
            state = self.job.get() if self.job.exists() else None
            status, attempts, ready = state or (None, 0, 0)
            if message.action == "enqueue" and status is None:
                status, ready = "queued", now
            elif message.action == "claim" and status == "queued" and ready <= now:
                status, attempts, ready = "running", attempts + 1, now + LEASE * 1000
                self.handle.registerTimer(ready)
            elif message.action == "done" and status == "running":
                status = "done"
            elif message.action in ("fail", "fail_permanently") and status == "running":
                again = message.action == "fail" and attempts < ATTEMPTS
                status, ready = ("queued", now + backoff(attempts) * 1000) if again else ("failed", now)
            else:
                out.append((key[0], message.action, "ignored", attempts))
                continue
            self.job.update((status, attempts, ready))
            out.append((key[0], message.action, status, attempts))
        yield pd.DataFrame(out, columns=["job", "action", "status", "attempts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, ready = self.job.get()
        if status == "running" and ready <= expiredTimerInfo.getExpiryTimeInMs():
            status = "queued" if attempts < ATTEMPTS else "failed"
            self.job.update((status, attempts, ready))
            yield pd.DataFrame([(key[0], "lease_ended", status, attempts)], columns=["job", "action", "status", "attempts"])
        else:
            yield pd.DataFrame([], columns=["job", "action", "status", "attempts"])

    def close(self) -> None:
        pass


def processed(messages: DataFrame) -> DataFrame:
    """The queue's answers to a stream of (job, action, at)."""
    return messages.withWatermark("at", "1 minute").groupBy("job").transformWithStateInPandas(JobQueue(), "job string, action string, status string, attempts int", "append", "eventTime")


def stable_files(scans: DataFrame, needed: int) -> DataFrame:
    """(path, scan): files seen with equal size and time in `needed` scans in a row, at the first scan where that holds."""
    order = Window.partitionBy("path").orderBy("scan")
    changed = F.coalesce((F.col("size") != F.lag("size").over(order)) | (F.col("mtime") != F.lag("mtime").over(order)) | (F.col("scan") != F.lag("scan").over(order) + 1), F.lit(True))
    runs = scans.withColumn("run", F.sum(changed.cast("int")).over(order))
    seen = runs.withColumn("n", F.row_number().over(Window.partitionBy("path", "run").orderBy("scan")))
    return seen.where(F.col("n") == needed).groupBy("path").agg(F.min("scan").alias("scan"))


def drained(stream: DataFrame, name: str, mode: str = "complete", longest: timedelta = timedelta(hours=6)) -> DataFrame:
    """Run a stream over what is there now and give its result as a table of Parquet files in the shared folder.

    Each batch has a folder of its own, written anew if it is run again. In complete mode the last one is the result; in
    update mode all are, with the number of the batch.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"  # a run is a whole one: it takes up no other's state

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    if not run.awaitTermination(longest.total_seconds()):
        run.stop()
        raise TimeoutError(name)
    if run.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "update":
        return spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{path}/out")
    out = spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*") if mode == "append" else spark.read.schema(stream.schema).parquet(f"{path}/out/batch={run.lastProgress['batchId']}")
    return out


def upserted(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream of updates over what is there now and give the last row of each key."""
    numbered = drained(stream, name, "update")
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return numbered.withColumn("n__", F.row_number().over(order)).where("n__ = 1").drop("n__", "batch")


def in_steps(spark: SparkSession, steps: list[DataFrame], name: str) -> DataFrame:
    """A stream of tables, one after the other: each is written as so many files of a folder of this run's own, and a batch of the stream takes so many.

    How many is what the largest table needs at STEP_ROWS a file, so no task writes or reads a table alone; a table that
    makes fewer files is filled up with empty ones. Tables are counted and then written: give them stored.
    """
    path = f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex}"
    files = max(1, -(-max(step.count() for step in steps) // STEP_ROWS))
    before = 0
    for step in steps:
        step.repartition(files).write.mode("append").parquet(path)
        made = len(spark.read.schema(step.schema).parquet(path).inputFiles())
        for _ in range(before + files - made):
            step.limit(0).coalesce(1).write.mode("append").parquet(path)
        before += files
    return read_stream(spark, path, steps[0].schema, files)


def read_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
