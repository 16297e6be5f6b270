"""Streams with state, stores and watched folders: order, leases, late rows, restarts and failures."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexloom.sources import store
from lexloom.streaming import jobs, state, watch

START = datetime(2024, 1, 1)
MESSAGE = "queue string, action string, job long, at timestamp, created_at timestamp, run_after timestamp, worker string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def enqueue(job, created, ready=None, when=None):
    return ("q", "enqueue", job, at(created if when is None else when), at(created), at(created if ready is None else ready), None)


def act(action, when, job=None, worker="w"):
    return ("q", action, job, at(when), None, None, worker)


def run(spark, steps, late="1 day"):
    frames = [spark.createDataFrame(s, MESSAGE) for s in steps]
    with state.kept_in_rocksdb(spark):
        told = jobs.drained(state.queued(jobs.in_steps(spark, frames, "test"), late), "test", "append")
    seconds = F.unix_seconds("at") - F.unix_seconds(F.lit(START))
    return [(r["action"], r["job"], r["status"], r["attempts"], r["s"]) for r in told.select("*", seconds.alias("s")).orderBy("at", "job").collect() if r["action"] != "enqueue"]


def test_claims_take_the_first_job_that_is_due(spark):
    got = run(spark, [[enqueue(3, 300), enqueue(1, 100, ready=5000)], [enqueue(2, 200, when=350), *(act("claim", 1000 + k) for k in range(3))], [act("claim", 6000), act("claim", 6001)]])
    # the third claim found nothing due; at 6000 the leases of 2 and 3 have ended and 1 is due, made before both
    assert [(r[0], r[1], r[2]) for r in got] == [("claim", 2, "running"), ("claim", 3, "running"), ("claim", None, "empty"), ("lease_ended", 2, "queued"), ("lease_ended", 3, "queued"), ("claim", 1, "running"), ("claim", 2, "running")]


def test_lost_leases_failures_and_last_attempts(spark):
    first = [enqueue(1, 0), enqueue(2, 10), act("claim", 20), act("fail", 30, 1), act("claim", 40)]  # 1 waits 30 seconds
    second = [act("claim", 60), act("done", 70, 2), act("done", 71, 2), act("claim", 60 + 601)]  # 1 again; its lease is lost; third attempt
    third = [act("claim", 60 + 601 + 601), act("fail_permanently", 2000, 9)]
    got = run(spark, [first, second, third])
    assert [r[:4] for r in got] == [
        ("claim", 1, "running", 1), ("fail", 1, "queued", 1), ("claim", 2, "running", 1), ("claim", 1, "running", 2), ("done", 2, "done", 1), ("done", 2, "ignored", 0),
        ("lease_ended", 1, "queued", 2), ("claim", 1, "running", 3), ("lease_ended", 1, "failed", 3), ("claim", None, "empty", 0), ("fail_permanently", 9, "ignored", 0),
    ]


def test_a_timer_ends_leases_without_messages(spark):
    other = [("other", *m[1:]) for m in [enqueue(7, 5000), enqueue(8, 9000)]]
    got = run(spark, [[enqueue(1, 0), act("claim", 10)], other, [("other", *enqueue(9, 9100)[1:])]], late="1 second")
    assert ("lease_ended", 1, "queued", 1, 610) in got


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_messages_gives_the_claims_of_a_plain_queue(spark, seed):
    rnd = random.Random(seed)
    rows = [enqueue(k, rnd.randrange(50_000)) for k in range(300)]
    rnd.shuffle(rows)
    claims = [act("claim", 60_000 + k) for k in range(300)]
    got = [r[1] for r in run(spark, [rows[:100], rows[100:], claims[:250], claims[250:]]) if r[0] == "claim" and r[2] == "running" and r[3] == 1]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[4], r[2]))]


def test_late_failures_correct_what_was_told(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), k, at(rnd.randrange(2000))) for k in range(200)]
    steps = [spark.createDataFrame(rows[a : a + 50], "user long, id long, ts timestamp") for a in range(0, 200, 50)]
    with state.kept_in_rocksdb(spark):
        told = jobs.upserted(state.limited(jobs.in_steps(spark, steps, "limit"), "user", "id", "ts", 60, 2, "1 day"), "limit", ["id"])
    got = {r["id"]: (r["recent"], r["blocked"]) for r in told.collect()}
    want = {i: sum(u == v and timedelta(0) <= t - x < timedelta(seconds=60) for v, _, x in rows) for u, i, t in rows}
    assert got == {i: (n, n > 2) for i, n in want.items()}


def test_times_that_no_event_can_reach_are_forgotten(spark):
    rows = [[("u", 1, at(0)), ("u", 2, at(10))], [("x", 3, at(5000))], [("u", 4, at(5001))]]
    steps = [spark.createDataFrame(r, "user string, id long, ts timestamp") for r in rows]
    with state.kept_in_rocksdb(spark):
        told = jobs.drained(state.limited(jobs.in_steps(spark, steps, "limit"), "user", "id", "ts", 60, 2, "1 second"), "limit", "update")
    assert sorted((r["id"], r["recent"]) for r in told.collect()) == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_steps_of_several_files_come_one_after_the_other(spark, monkeypatch):
    """Tables of more rows than a file takes, and shorter ones: a batch of the stream is a table, whole."""
    monkeypatch.setattr(jobs, "STEP_ROWS", 10)
    seen = []
    steps = [spark.range(a, b, numPartitions=2).select("id") for a, b in ((0, 35), (100, 101), (200, 220))]
    stream = jobs.in_steps(spark, steps, "several")
    run = stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r["id"] for r in batch.collect()))).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert seen == [list(range(35)), [100], list(range(200, 220))]


def test_a_scan_that_misses_a_file_begins_anew(spark):
    rows = [("a", k, 1, 1) for k in (1, 2, 3, 4, 5)] + [("b", k, 1, 1) for k in (1, 2, 4, 5, 6)] + [("c", 1, 1, 1), ("c", 2, 2, 1), ("c", 3, 2, 2), ("c", 4, 2, 2), ("c", 5, 2, 2)]
    scans = spark.createDataFrame([(*r, at(60 * r[1])) for r in rows], "path string, scan long, size long, mtime long, at timestamp")
    steps = [scans.where(F.col("scan") == k) for k in range(1, 7)]
    with state.kept_in_rocksdb(spark):
        told = jobs.drained(state.settled(jobs.in_steps(spark, steps, "files"), 3), "files", "append")
    assert sorted((r["path"], r["scan"], r["size"], r["mtime"]) for r in told.collect()) == [("a", 3, 1, 1), ("b", 6, 1, 1), ("c", 5, 2, 2)]


def test_sketches_keep_their_promise(spark):
    """Values by the million: ranks of merged quantiles are as near as promised; few values are told exactly."""
    rows = spark.range(300_000).select((F.col("id") % 2).alias("source"), (F.lit(START) + F.make_dt_interval(days=(F.col("id") % 10).cast("int"))).alias("discovered_at"), F.pmod(F.xxhash64("id"), F.lit(10_000_000)).alias("us"))
    jobs_ = rows.withColumn("published_at", F.timestamp_micros(F.unix_micros("discovered_at") + F.col("us") * 3600))
    got = state.sliding_quantiles(state.sketched(jobs_)).collect()
    assert {r["published"] for r in got if r["day"].day == 10} == {90_000, 120_000, 210_000}  # days of one source are even or odd
    for r in got:
        for p, value in ((0.5, r["p50_hours"]), (0.95, r["p95_hours"])):
            assert abs(value * 3.6e9 / 3600 / 10_000_000 - p) < 0.01
    last = [r for r in got if r["day"].day == 10 and r["source"] is None][0]
    seven = jobs_.where(F.col("discovered_at") >= F.lit(START + timedelta(days=3)))
    for p, value in ((0.5, last["p50_hours"]), (0.95, last["p95_hours"])):
        rank = seven.where(F.col("us") * 3600 / 3.6e9 <= value).count() / seven.count()
        assert abs(rank - p) <= 3 * state.RANK_ERROR


def test_quantiles_of_more_jobs_than_a_sketch_keeps_are_exact(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("source"), (F.lit(START) + F.make_dt_interval(days=(F.floor(F.col("id") / 2) % 3).cast("int"))).alias("discovered_at"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("us"))
    jobs_ = rows.withColumn("published_at", F.timestamp_micros(F.unix_micros("discovered_at") + F.col("us") * 3600))
    got = {(r["source"], r["day"].day): (r["published"], round(r["p50_hours"] * 1e6), round(r["p95_hours"] * 1e6)) for r in state.sliding_exact(jobs.durations(jobs_), [50, 95], 2).collect()}
    told = [(r["source"], r["discovered_at"].day, r["us"]) for r in jobs_.collect()]
    for (source, day), found in got.items():
        own = sorted(us for s, d, us in told if source in (None, s) and day - 1 <= d <= day)
        assert found == (len(own), own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1])
    assert len(got) == 9


def test_objects_one_by_one(tmp_path):
    s = store.Store(f"file://{tmp_path}")
    s.put("a/b", b"one")
    s.put("a/b", b"two")
    assert s.get("a/b") == b"two" and s.exists("a/b") and not s.exists("a") and s.list() == [("a/b", 3)] and s.list("x") == []
    assert s.delete("a/b") and not s.delete("a/b") and s.list() == []
    for bad in ("", "/a", "a/", "a//b", "../a", "a/../b", "a\\b", "a\0b"):
        with pytest.raises(ValueError):
            s.put(bad, b"")


def test_a_failed_write_leaves_nothing_and_contents_are_stored_once(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    rows = spark.createDataFrame([(bytearray(f"text {k % 20}".encode()),) for k in range(60)], "content binary").repartition(4)
    bad = spark.createDataFrame([("fine", bytearray(b"1")), ("../evil", bytearray(b"2"))], "key string, content binary").repartition(2)
    with pytest.raises(Exception, match="not a key"):
        store.store(bad, root)
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
    store.store(rows, root)
    before = {k: os.stat(f"{tmp_path}/objects/{k}").st_mtime_ns for k, _ in store.Store(root).list()}
    store.store(rows, root)
    assert len(before) == 20 and before == {k: os.stat(f"{tmp_path}/objects/{k}").st_mtime_ns for k in before}
    spark.dataSource.register(store.ObjectStore)
    read = spark.read.format("object_store").option("partitionBytes", "20").load(root)
    assert sorted(bytes(r["content"]) for r in read.collect()) == sorted({f"text {k}".encode() for k in range(20)})
    assert read.rdd.getNumPartitions() > 3
    named = spark.createDataFrame([("meta/x", bytearray(b"named"))], "key string, content binary")
    store.store(named, root)
    assert store.Store(root).get("meta/x") == b"named"
    assert [r["key"] for r in store.stored(spark, root, "meta").collect()] == ["meta/x"]


def until(condition, seconds=90):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


def test_watched_files_move_once_and_a_restart_goes_on(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for folder, name, text in (("act", "one.html", "<html>1"), ("act", "two.bin", "zzz"), ("novel", "x.html", "<html>"), ("act", ".hidden", "<html>")):
        (root / "gazette" / folder).mkdir(parents=True, exist_ok=True)
        (root / "gazette" / folder / name).write_text(text)
    here = lambda: sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    run = watch.watch(spark, f"file://{root}", f"file://{out}", seconds=0.5)
    until(lambda: sum(p.startswith((".done", ".failed")) for p in here()) == 5)
    run.stop()
    (root / "gazette" / "act" / "late.html").write_text("<html>2")
    run = watch.watch(spark, f"file://{root}", f"file://{out}", seconds=0.5)
    until(lambda: sum(p.startswith(".done") for p in here()) == 2 and (out / "requests").exists())
    run.stop()
    files = here()
    assert [p for p in files if not p.startswith(".")] == ["gazette/act/.hidden"]
    assert sorted(p.rsplit("__")[1] for p in files if p.startswith(".failed")) == ["two.bin", "two.bin.reason.txt", "x.html", "x.html.reason.txt"]
    rows = watch.requests(spark, f"file://{out}").collect()
    assert sorted((r["source"], r["doc_type"], r["file"].rsplit("__")[1], r["problem"]) for r in rows) == [("gazette", "act", "late.html", None), ("gazette", "act", "one.html", None), ("gazette", "act", "two.bin", "neither PDF nor HTML"), ("gazette", "novel", "x.html", "unknown document type: novel")]


def test_a_batch_that_runs_again_moves_nothing_twice(tmp_path):
    (tmp_path / "s" / "act").mkdir(parents=True)
    file = tmp_path / "s" / "act" / "a.html"
    file.write_text("<html>")
    root, seen = f"file://{tmp_path}", ("s/act/a.html", 6, file.stat().st_mtime_ns)
    plan = watch.planned(root, *seen)
    watch.move(root, seen[0], *plan)
    watch.move(root, seen[0], *plan)
    assert (tmp_path / plan[0]).read_text() == "<html>" and not file.exists()
    file.write_text("<html> a new file of that name")
    watch.move(root, seen[0], *plan)  # the old plan does not take the new file
    assert file.exists() and (tmp_path / plan[0]).read_text() == "<html>"
    with pytest.raises(FileNotFoundError):
        watch.planned(root, "s/act/gone.html", 1, 1)
