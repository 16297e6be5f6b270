"""Operators that keep state of their own over streams: queues in order, sliding limits, files that have settled.

Each is the streamed twin of a batch operator and gives its rows: `JobsInOrder` of `stages.claimable`, `limited` of
`jobs.over_limit`, `settled` of `jobs.stable_files`. Times are event times; state goes when the watermark has passed
all that could still need it.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import ATTEMPTS, LEASE, backoff, quantiles

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HOUR = 3_600_000_000


@contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as operators with state of their own must."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


class _Ordered:
    """An ordered map in state: jobs by (created, id) in buckets of an hour, of which a claim opens the first ones only.

    Buckets that are opened stay in memory until `flush`, which writes back those that changed.
    """

    def __init__(self, index, buckets):
        self.index, self.buckets = index, buckets
        self.hours: list[int] = json.loads(index.get()[0]) if index.exists() else []
        self.open: dict[int, list[list[int]]] = {}
        self.changed: set[int] = set()

    def _bucket(self, hour: int) -> list[list[int]]:
        if hour not in self.open:
            self.open[hour] = json.loads(self.buckets.getValue((hour,))[0]) if self.buckets.containsKey((hour,)) else []
        return self.open[hour]

    def put(self, created: int, job: int, ready: int, attempts: int) -> None:
        hour = created // _HOUR
        insort(self._bucket(hour), [created, job, ready, attempts])
        at = bisect_left(self.hours, hour)
        if at == len(self.hours) or self.hours[at] != hour:
            self.hours.insert(at, hour)
        self.changed.add(hour)

    def take(self, now: int) -> list[int] | None:
        """The first job that is due."""
        for hour in self.hours:
            own = self._bucket(hour)
            for k, job in enumerate(own):
                if job[2] <= now:
                    del own[k]
                    self.changed.add(hour)
                    return job
        return None

    def flush(self) -> None:
        for hour in self.changed:
            if self.open[hour]:
                self.buckets.updateValue((hour,), (json.dumps(self.open[hour]),))
            else:
                self.buckets.removeKey((hour,))
        self.hours = [h for h in self.hours if h not in self.changed or self.open[h]]
        if self.changed:
            self.index.update((json.dumps(self.hours),))


class JobsInOrder(StatefulProcessor):
    """A queue: jobs come in, and each claim takes the first job made of those that are due.

    A claim starts a lease. When a lease ends, by a later message or by its timer, the job returns to its place or, after its
    last attempt, fails. A failure waits for its back-off in its place; a permanent one ends the job. Messages of a batch are
    taken in the order of their times; at one time jobs come in first and claims come last.
    """

    ORDER = {"enqueue": 0, "done": 1, "fail": 2, "fail_permanently": 3, "claim": 4}
    OUT = "queue string, job long, action string, status string, attempts int, worker string, at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("hours", "hours string")
        self.buckets = handle.getMapState("waiting", "hour long", "jobs string")
        self.running = handle.getMapState("running", "job long", "created long, ends long, attempts int, worker string")

    def _released(self, queue: str, now: int, waiting: _Ordered, running: dict[int, tuple], out: list[tuple]) -> None:
        """Jobs whose lease has ended by now, in the order of these ends."""
        for ends, job in sorted((r[1], job) for job, r in running.items() if r[1] <= now):
            created, _, attempts, worker = running.pop(job)
            again = attempts < ATTEMPTS
            if again:
                waiting.put(created, job, ends, attempts)
            out.append((queue, job, "lease_ended", "queued" if again else "failed", attempts, worker, ends))

    def _begin(self) -> tuple[_Ordered, dict[int, tuple], set[int]]:
        running = {k[0]: tuple(v) for k, v in self.running.iterator()}
        return _Ordered(self.index, self.buckets), running, set(running)

    def _end(self, waiting: _Ordered, running: dict[int, tuple], before: set[int]) -> None:
        waiting.flush()
        for job in before - set(running):
            self.running.removeKey((job,))
        for job, value in running.items():
            self.running.updateValue((job,), value)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, running, before = self._begin()
        messages = pd.concat(list(rows))
        messages["order"] = messages["action"].map(self.ORDER)
        out: list[tuple] = []
        for m in messages.sort_values(["at_us", "order", "created_us", "job", "worker"]).itertuples():
            now = int(m.at_us)
            self._released(key[0], now, waiting, running, out)
            if m.action == "enqueue":
                waiting.put(int(m.created_us), int(m.job), int(m.ready_us), 0)
                out.append((key[0], int(m.job), m.action, "queued", 0, None, now))
            elif m.action == "claim":
                job = waiting.take(now)
                if job is None:
                    out.append((key[0], None, m.action, "empty", 0, m.worker, now))
                    continue
                running[job[1]] = (job[0], now + LEASE * 1_000_000, job[3] + 1, m.worker)
                self.handle.registerTimer(running[job[1]][1] // 1000 + 1)
                out.append((key[0], job[1], m.action, "running", job[3] + 1, m.worker, now))
            elif int(m.job) not in running:
                out.append((key[0], int(m.job), m.action, "ignored", 0, m.worker, now))
            else:
                created, _, attempts, worker = running.pop(int(m.job))
                again = m.action == "fail" and attempts < ATTEMPTS
                if again:
                    waiting.put(created, int(m.job), now + backoff(attempts) * 1_000_000, attempts)
                out.append((key[0], int(m.job), m.action, "done" if m.action == "done" else "queued" if again else "failed", attempts, worker, now))
        self._end(waiting, running, before)
        yield self._told(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, running, before = self._begin()
        out: list[tuple] = []
        self._released(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000, waiting, running, out)
        self._end(waiting, running, before)
        yield self._told(out)

    @staticmethod
    def _told(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["queue", "job", "action", "status", "attempts", "worker", "at"])
        return frame.astype({"job": "Int64", "attempts": "int32", "at": "int64"})

    def close(self) -> None:
        pass


def queued(messages: DataFrame, late: str = "1 minute") -> DataFrame:
    """What becomes of messages (queue, action, job, at, created_at, run_after, worker) to queues, as they come."""
    rows = messages.withWatermark("at", late).select(F.col("queue").cast("string").alias("queue"), "action", F.col("job").cast("long").alias("job"), "worker", "at", _micros("at").alias("at_us"), _micros("created_at").alias("created_us"), _micros("run_after").alias("ready_us"))
    told = rows.fillna({"job": -1, "created_us": 0, "ready_us": 0}).groupBy("queue").transformWithStateInPandas(JobsInOrder(), JobsInOrder.OUT, "append", "eventTime")
    return told.withColumn("at", F.timestamp_micros("at"))


#: Keys of limits and files are kept together in so many buckets: a call of Python a key and step would cost more than its rows.
BUCKETS = 256


def _in_buckets(rows: DataFrame, key: str, step: Callable, schema: str, mode: str) -> DataFrame:
    """step(rows, what is kept by key, watermark) gives rows of `schema` and until when (in milliseconds) the rest must be kept."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = {k: own for k, own in json.loads(state.get[0])} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        out, until = step((row for f in frames for row in f.drop(columns=["bucket", "at"]).itertuples(index=False, name=None)), kept, watermark)
        state.update((json.dumps(list(kept.items()), separators=(",", ":")),))
        state.setTimeoutTimestamp(max(until, watermark + 1))
        yield pd.DataFrame(out, columns=names).astype({n: "int64" for n in names[1:]})

    names = [c.split()[0] for c in schema.split(", ")]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(run, schema, "kept string", mode, GroupStateTimeout.EventTimeTimeout)


def _sliding(window: int) -> Callable:
    """How many of a key's events fall into the `window` microseconds that end with an event.

    An event is answered when it comes; events that come later and fall into an earlier one's window answer that one again.
    The times that a late event could still reach are kept, and go when the watermark has passed their window.
    """

    def step(rows: Iterator[tuple], kept: dict, watermark: int) -> tuple[list[tuple], int]:
        come: dict = {}
        for key, i, at in rows:
            come.setdefault(key, []).append((int(at), int(i)))
        changed, last = [], watermark * 1000
        for key, events in come.items():
            new = sorted(events)
            held = sorted([*map(tuple, kept.get(key, ())), *new])
            stamps, times, fresh = [at for at, _ in held], [at for at, _ in new], set(new)
            for at, i in held[bisect_left(stamps, times[0]) :]:
                reached = bisect_right(times, at) - bisect_right(times, at - window)
                if reached or (at, i) in fresh:
                    changed.append((key, i, bisect_right(stamps, at) - bisect_right(stamps, at - window)))
            kept[key] = held
        for key in list(kept):
            kept[key] = [x for x in kept[key] if x[0] > watermark * 1000 - window]
            if kept[key]:
                last = max(last, kept[key][-1][0] + window)
            else:
                del kept[key]
        return changed, last // 1000 + 1

    return step


def limited(failures: DataFrame, key: str, id_: str, at: str, seconds: int, most: int, late: str = "1 hour") -> DataFrame:
    """(key, id, recent, blocked): a row for each failure, and another where a late one changes it; the last one of an id holds."""
    rows = failures.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(id_).cast("long").alias("id"), F.col(at).alias("at"), _micros(at).alias("at_us"))
    return _in_buckets(rows, "key", _sliding(seconds * 1_000_000), "key string, id long, recent long", "update").withColumn("blocked", F.col("recent") > most)


#: Milliseconds after which a file that no scan has seen is forgotten.
FORGET = 24 * 3_600_000


def _settling(needed: int) -> Callable:
    """A file is told once it has had equal size and time in so many scans in a row; another size or time begins anew.

    A scan that misses the file begins anew too.
    """

    def step(rows: Iterator[tuple], kept: dict, watermark: int) -> tuple[list[tuple], int]:
        out, last = [], {}
        for path, scan, size, mtime, at in sorted(rows, key=lambda r: r[1]):
            scan, sign, at = int(scan), [int(size), int(mtime)], int(at)
            known = kept.get(path)
            same = known is not None and known[:2] == sign
            scans, told = (known[3] + 1 if same and known[2] + 1 == scan else 1), same and known[4]
            if scans >= needed and not told:
                out.append((path, scan, *sign))
                told = True
            last[path] = max(last.get(path, 0), at)
            kept[path] = [*sign, scan, scans, told, last[path] + FORGET]
        for path in [p for p, known in kept.items() if known[5] <= watermark]:
            del kept[path]
        return out, max((known[5] for known in kept.values()), default=watermark)

    return step


def settled(scans: DataFrame, needed: int, late: str = "1 hour") -> DataFrame:
    """(path, scan, size, mtime): files of scans (path, scan, size, mtime, at) at the scan in which they settled."""
    rows = scans.withWatermark("at", late).select(F.col("path").cast("string").alias("path"), F.col("scan").cast("long").alias("scan"), F.col("size").cast("long").alias("size_"), F.col("mtime").cast("long").alias("mtime"), "at", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    return _in_buckets(rows, "path", _settling(needed), "path string, scan long, size long, mtime long", "append")


#: Ranks of a sketch's quantiles are off by at most this share (of 99 in 100 sketches) at so many kept items.
KEPT, RANK_ERROR = 4096, 0.001


def sketched(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """A mergeable sketch of the hours from discovery to publication for each source and day, kept as a stream's state."""
    rows = jobs.withWatermark("discovered_at", late) if jobs.isStreaming else jobs
    took = (_micros("published_at") - _micros("discovered_at")) / 3.6e9
    return rows.where("published_at is not null").groupBy("source", F.window("discovered_at", "1 day").alias("w")).agg(F.kll_sketch_agg_double(took, KEPT).alias("sketch")).select("source", F.to_date("w.start").alias("day"), "sketch")


def sliding_quantiles(sketches: DataFrame, days: int = 7) -> DataFrame:
    """(source, day, published, p50_hours, p95_hours) of the `days` days that end with a day, for each source and (null) for all.

    Days' sketches are merged, not their values; a quantile's rank is off by at most RANK_ERROR of the values, and by
    nothing where fewer than KEPT were seen.
    """
    ends = sketches.select("source", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"), "sketch").join(sketches.select("day").distinct(), "day")
    every = ends.unionByName(ends.withColumn("source", F.lit(None).cast(ends.schema["source"].dataType)))
    merged = every.groupBy("source", "day").agg(F.kll_merge_agg_double("sketch", KEPT).alias("s"))
    quantile = lambda p: F.kll_sketch_get_quantile_double("s", F.lit(p))
    return merged.select("source", "day", F.kll_sketch_get_n_double("s").alias("published"), quantile(0.5).alias("p50_hours"), quantile(0.95).alias("p95_hours"))


def sliding_exact(counts: DataFrame, percents: list[int], days: int = 7) -> DataFrame:
    """(source, day, published, pNN_hours ...) as sliding_quantiles gives them, exact: from counted durations (source, day, took, n) of days.

    A duration of a day and source is one row, however many jobs had it, and counts to the `days` days that it falls into.
    """
    ends = counts.select("source", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"), "took", "n").join(counts.select("day").distinct(), "day")
    each = ends.groupBy("source", "day", "took").agg(F.sum("n").alias("n"))
    every = each.groupBy("day", "took").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast(each.schema["source"].dataType))
    return quantiles(each.unionByName(every), ["source", "day"], percents)
