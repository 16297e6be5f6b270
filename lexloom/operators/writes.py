"""Slowly changing writes, as new snapshots computed from old ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded


def upsert(stored: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """stored with given's rows in place of those of equal key; both have the same columns."""
    return stored.join(given, key, "left_anti").unionByName(given)


def insert_absent(stored: DataFrame, given: DataFrame, *keys: str) -> DataFrame:
    """The given rows whose key is not stored yet, one a key."""
    return given.dropDuplicates(list(keys)).join(stored, list(keys), "left_anti")


def baseline_actions(draft: DataFrame, live: DataFrame, key: str, digest: str, amended: str) -> DataFrame:
    """What a new baseline does with each key: create, unchanged, replace, skip (amended since) or orphan."""
    a, b = draft.alias("a"), live.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    action = (
        F.when(F.col(f"b.{key}").isNull(), "create")
        .when(F.col(f"a.{key}").isNull(), "orphan")
        .when(F.col(f"a.{digest}") == F.col(f"b.{digest}"), "unchanged")
        .when(F.col(f"b.{amended}"), "skip")
        .otherwise("replace")
    )
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), action.alias("action"), F.col(f"a.{digest}").alias("new_digest"), F.col(f"b.{digest}").alias("old_digest"))


def snapshot(draft: DataFrame, live: DataFrame, actions: DataFrame, key: str, at: Column) -> DataFrame:
    """live with replaced rows closed on record, and the created and replacing rows added."""
    todo = actions.select(key, "action")
    closed = live.join(todo, key).withColumn("rec_to", F.when((F.col("action") == "replace") & F.col("rec_to").isNull(), at).otherwise(F.col("rec_to")))
    added = draft.join(todo.where("action in ('create', 'replace')"), key).withColumn("rec_from", at).withColumn("rec_to", F.lit(None).cast(live.schema["rec_to"].dataType))
    names = live.columns
    return closed.select(*names).unionByName(added.select(*names))


def status_history(changes: DataFrame, key: str) -> DataFrame:
    """changes (key, status, valid_from) as intervals; repeats of the status before are dropped."""
    order = Window.partitionBy(key).orderBy("valid_from")
    kept = changes.withColumn("before", F.lag("status").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("status"))).drop("before")
    return kept.withColumn("valid_to", F.lead("valid_from").over(order))


def merged_versions(versions: DataFrame, mapping: DataFrame, key: str, order: str) -> DataFrame:
    """versions under their merge target, renumbered from 1."""
    moved = versions.join(mapping, key, "left").withColumn("target", F.coalesce("target", key))
    return moved.withColumn("version_no", F.row_number().over(Window.partitionBy("target").orderBy(order, key)))


def merged_urls(urls: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """urls (key, url, first_seen, last_seen) under their merge target: the widest interval for each."""
    moved = urls.join(mapping, key, "left").withColumn("target", F.coalesce("target", key))
    return moved.groupBy("target", "url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merged_metadata(old: Column, proposal: Column, explicit: Column) -> Column:
    """Maps merged by precedence: explicit fields over the proposal over old ones."""
    pick = lambda key: F.coalesce(explicit[key], proposal[key], old[key])
    keys = F.array_sort(F.array_union(F.array_union(F.map_keys(old), F.map_keys(proposal)), F.map_keys(explicit)))
    return F.map_from_arrays(keys, F.transform(keys, pick))


GENESIS = "0" * 64


def canonical_json(row: dict) -> str:
    """A row as JSON with sorted keys, no spaces and letters as they are."""
    return json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def chained(log: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """(chain, order, prev_hash, row_hash) of each row: its hash is that of the hash before it in its chain followed by its payload.

    A chain is one after the other by its nature; its rows stream through one task, and chains go side by side.
    """
    kinds = ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in (chain, order))

    def body(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        before = GENESIS
        for _, at, told in rows:
            now = hashlib.sha256((before + told).encode()).hexdigest()
            yield key[0], at, before, now
            before = now

    return folded(log.select(chain, order, payload), [chain], [order], body, f"{kinds}, prev_hash string, row_hash string")


def verified(log: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """log (prev_hash, row_hash): whether each row follows from its payload and the row before; no row is read twice."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    good = (F.col("prev_hash") == before) & (F.col("row_hash") == F.sha2(F.concat("prev_hash", payload), 256))
    return log.withColumn("ok", F.coalesce(good, F.lit(False)))


def round_robin(tasks: DataFrame, task: str, editors: DataFrame, editor: str) -> DataFrame:
    """Tasks dealt in order to editors in order.

    Ranks come from ranges of task ids: each range counts its tasks, the few counts are summed up, and a task's rank is
    its range's start plus its rank inside, so no task list is sorted in one place.
    """
    ranked = ranks(tasks, task)
    order = editors.select(editor).distinct()
    places = ranks(order, editor).withColumnRenamed("rank", "place").select(editor, "place")
    total = order.count()
    return ranked.withColumn("place", F.col("rank") % F.lit(max(1, total))).join(places, "place").select(task, editor)


def ranks(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """df with `rank`, the place of a row (from 0) in the order of a unique numeric column.

    Rows are sorted in ranges, as many as a shuffle has partitions (64 to 1,024), whose counts alone reach the driver.
    """
    ranges = ranges or min(1024, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    cuts = df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col(column))) if cuts else F.lit(0)
    placed = df.withColumn("part__", part)
    counts = {r["part__"]: r["count"] for r in placed.groupBy("part__").count().collect()}  # at most `ranges` rows
    first, before = {}, 0
    for k in sorted(counts):
        first[k], before = before, before + counts[k]
    starts = F.lit([first.get(k, 0) for k in range(ranges + 1)]).cast("array<bigint>")
    inside = F.row_number().over(Window.partitionBy("part__").orderBy(column)) - 1
    return placed.withColumn("rank", F.element_at(starts, F.col("part__") + 1) + inside).drop("part__")


def sampled(df: DataFrame, key: str, percent: float, seed: str) -> DataFrame:
    """A repeatable random sample without replacement: the rows of least hash, max(1, round(n * percent / 100)) of them.

    Hashes are even, so the least ones lie below a bound a little over the sample's share: only rows below it are ranked. Where
    fewer rows than the sample lie there, all are.
    """
    n = df.count()
    take = max(1, round(n * percent / 100)) if n else 0
    hashed = df.withColumn("hash__", F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long"))
    bound = min(1.0, (take + 6 * take**0.5 + 20) / n) if n else 1.0
    below = hashed.where(F.col("hash__") <= int(bound * (16**15 - 1)))
    if bound < 1 and below.count() < take:
        below = hashed
    return ranks(below, "hash__").where(F.col("rank") < take).select(*df.columns)


def first_status(stored: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, status, valid_from) for documents without any status row yet."""
    return documents.join(stored.select(key).distinct(), key, "left_anti").select(key, F.lit("in_force").alias("status"), F.coalesce("in_force_date", "doc_date").alias("valid_from"))


def set_status(stored: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(history, rejected): stored rows (key, status, valid_from, valid_to) with the open one closed where a change begins after it; earlier changes are rejected."""
    opened = stored.where("valid_to is null").select(key, F.col("valid_from").alias("since"))
    joined = changes.join(opened, key, "left")
    fits = F.col("since").isNull() | (F.col("valid_from") >= F.col("since"))
    good = joined.where(fits).select(key, "status", "valid_from")
    ends = good.select(key, F.col("valid_from").alias("ends"))
    closed = stored.join(ends, key, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("ends")).otherwise(F.col("valid_to"))).select(*stored.columns)
    return closed.unionByName(good.withColumn("valid_to", F.lit(None).cast("date")).select(*stored.columns)), joined.where(~fits).select(key, "status", "valid_from")


def replaced(stored: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """stored with all rows of the keys in `touched` given anew: what was derived from a version before goes."""
    return stored.join(given.select(key).distinct(), key, "left_anti").unionByName(given)


def overwrite(df: DataFrame, path: str, *keys: str) -> None:
    """Write rows under the folders of their keys; folders that get rows are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def collisions(documents: DataFrame, key: str, identifier: str) -> DataFrame:
    """(identifier, n, first): identifiers that more than one document claims."""
    return documents.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.countDistinct(key).alias("n"), F.min(key).alias("first")).where("n > 1")


def corpus_versions(changes: DataFrame, at: str) -> DataFrame:
    """changes with the corpus version each makes: they are counted in order, by ranges of their times."""
    return ranks(changes.withColumn("at__", F.unix_micros(F.col(at).cast("timestamp"))), "at__").withColumn("corpus_version", F.col("rank") + 1).drop("at__", "rank")


def with_overrides(documents: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """documents (key, fields) with the edited fields of (key, field, value, edited_by, at) set and every edit logged; of edits of one field the last holds."""
    log = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "field", "value", "edited_by"))).alias("overrides"))
    last = edits.groupBy(key, "field").agg(F.max_by("value", "at").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("edited"))
    joined = documents.join(log, key, "left").join(last, key, "left")
    none = F.create_map().cast("map<string,string>")
    return joined.withColumn("fields", merged_metadata(F.col("fields"), none, F.coalesce("edited", none))).drop("edited")
