"""A prefix trie of conversations: every distinct sequence of first turns, with what its subtree shares.

A conversation is its path: 20 bytes a turn, 16 of a digest of role and text and 4 of the text's code points. Equal paths
are one row with a number of members, their least id and a hash of their ids, so copies cost a row whatever their number.
Paths are dealt to tasks by the digest of their first turn, many first turns to a task, and `forest` builds the tries of a
task as dictionaries of pointers and sums them up in postorder, without recursion, inside `applyInPandas`.

A first turn whose subtree holds more turns than a task should is split: its paths' common beginning (the common beginning
of the least and the greatest of them, since paths are ordered) becomes a chain of nodes, and what follows is dealt by the
next turn; subtrees that are still too large are split again. Each round handles all large subtrees at once, and a chain
of any depth takes one round. At the end the chains get the sums of the subtrees below them, deepest first. Only the
number of rows of a round reaches the driver.

Defined cases: turns are ordered by turn, null first, rows of one turn by the digest of role and text; null roles and
texts count as empty; repeated rows are turns each; rows without conv_id belong to no conversation; conversations without
turns are members of the root alone; an empty table has no nodes; other columns are ignored; a very long text is read
once, for its digest; a very long conversation is one row of 20 bytes a turn, and a path that no other shares is never
split. The hash of a node's ids is one sequence by nature: the ids of equal conversations are sorted by Spark and
read one by one, so a hot conversation costs its task time and not memory.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of a turn in a path, and its digest's.
TURN, DIGEST = 20, 16
#: Turns that a task's tries should have at most, and at least before a subtree is worth splitting.
MOST, LEAST = 100_000, 1_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [c.split()[0] for c in NODE.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


def _key(path: Column) -> Column:
    """16 bytes that stand for a path."""
    return F.unhex(F.substring(F.sha2(path, 256), 1, 2 * DIGEST))


def paths_of(conversations: DataFrame) -> DataFrame:
    """conv_id and path of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.concat(F.substring(F.sha2(told, 256), 1, 2 * DIGEST), F.lpad(F.hex(F.length(text).cast("long")), 2 * (TURN - DIGEST), "0"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn.alias("hex"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("turn", "hex"))), lambda x: x["hex"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(told, "")).alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation c behind the first turns of conversation c - c % 100, as many as c's checksum says."""
    hundred = F.col("conv_id") - F.col("conv_id") % 100
    heads = paths.where(hundred == F.col("conv_id")).select(F.col("conv_id").alias("head"), F.substring("path", 1, 5 * TURN).alias("lead"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    both = paths.withColumn("head", hundred).join(heads, "head", "left").withColumn("n", n)
    size = F.greatest(F.octet_length("path") - F.col("n") * TURN, F.lit(0))
    lead = F.coalesce(F.substring(F.col("lead"), F.lit(1), F.col("n") * TURN), F.unhex(F.lit("")))
    return both.select("conv_id", F.concat(lead, F.substring(F.col("path"), F.col("n") * TURN + 1, size)).alias("path"))


def _ids_hashed(rows: DataFrame) -> DataFrame:
    """For each key the hash of its conv_ids, ascending and comma-joined; a key's ids are read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for now, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(b"%d" % conv_id)
                else:
                    digest.update(b",%d" % conv_id)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends"])

    return rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """path, turns, n (members), least (their least id) and ends (the hash of their ids): a row for each distinct path."""
    keyed = paths.withColumn("key", _key(F.col("path")))
    each = keyed.groupBy("key").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return each.join(_ids_hashed(keyed), "key").select("path", F.expr(f"octet_length(path) div {TURN}").alias("turns"), "n", "least", "ends")


def forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of paths, each path from the turn behind its base on.

    rows: base (turns that stand above), parent (the least id there), up (the key of what stands above), path, n, least, ends.
    A node: [ways on, last turn, members, least id, parent's id, hash of those that end, above, depth].
    """
    roots: dict[bytes, dict] = {}
    nodes: list[list] = []
    for base, parent, up, path, n, least, ends in rows[["base", "parent", "up", "path", "n", "least", "ends"]].itertuples(index=False):
        ways, above = roots.setdefault(up, {}), -1
        for depth in range(base, len(path) // TURN):
            turn = path[depth * TURN : (depth + 1) * TURN]
            at = ways.get(turn)
            if at is None:
                at = ways[turn] = len(nodes)
                nodes.append([{}, turn, 0, least, above, _NONE, up if above < 0 else None, depth + 1, parent])
            node = nodes[at]
            node[2] += n
            node[3] = min(node[3], least)
            ways, above = node[0], at
        nodes[above][5] = ends
    leaves, saved = [0] * len(nodes), [0] * len(nodes)
    for at in range(len(nodes) - 1, -1, -1):  # a node stands behind those above it, so this is a postorder
        node = nodes[at]
        leaves[at] += not node[0]
        saved[at] += (node[2] - 1) * struct.unpack(">I", node[1][DIGEST:])[0]
        if node[4] >= 0:
            leaves[node[4]] += leaves[at]
            saved[node[4]] += saved[at]
    out = [(x[3], x[7], nodes[x[4]][3] if x[4] >= 0 else x[8], x[2], len(x[0]), leaves[k], saved[k], x[5], x[6]) for k, x in enumerate(nodes)]
    return pd.DataFrame(out, columns=[*NAMES, "up"])


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of each chain; its last one has the sums of what stands below, its first one names what stands above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                saved = x["below_saved"]
                for depth in range(x["until"], x["base"], -1):
                    chars = struct.unpack(">I", x["low"][depth * TURN - TURN + DIGEST : depth * TURN])[0]
                    saved += (x["n"] - 1) * chars
                    last, first = depth == x["until"], depth == x["base"] + 1
                    out.append((x["least"], depth, x["parent"] if first else x["least"], x["n"], x["below"] if last else 1, x["below_leaves"], saved, x["ends"] if last else _NONE, x["up"] if first else None))
            kinds = [*([pa.int64()] * 7), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[*NAMES, "up"])

    return rows.mapInArrow(run, f"{NODE}, up binary")


def _below(*nodes: DataFrame) -> DataFrame:
    """For each key what its children sum up to."""
    tops = nodes[0].where("up is not null")
    for more in nodes[1:]:
        tops = tops.unionByName(more.where("up is not null"))
    return tops.groupBy("up").agg(F.count("*").alias("below"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved")).withColumnRenamed("up", "key")


def trie(paths: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, path)."""
    spark = paths.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = materialise(distinct_paths(paths), "paths")
    whole = rows.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.col("turns") == 0, F.col("ends"))).alias("ends"), F.sum("turns").alias("turns")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODE)
    limit = min(most, max(least, whole["turns"] // tasks))
    buckets = max(tasks, -(-whole["turns"] // most))
    root = F.unhex(F.lit(""))  # the key of the textless root
    left = rows.where("turns > 0").select("*", F.lit(0).cast("long").alias("base"), F.lit(whole["least"]).alias("parent"), root.alias("up"))
    ready, chains = [], []
    while True:
        keyed = left.withColumn("key", F.unhex(F.substring(F.sha2(F.substring(F.col("path"), F.lit(1), ((F.col("base") + 1) * TURN).cast("int")), 256), 1, 2 * DIGEST)))
        groups = keyed.groupBy("key").agg(F.sum(F.col("turns") - F.col("base")).alias("size"), F.sum("n").alias("n_all"), F.min("least").alias("least_all"), F.min("path").alias("low"), F.max("path").alias("high"), F.first("base").alias("from"), F.first("parent").alias("above"), F.first("up").alias("over"))
        large = groups.where((F.col("size") > limit) & (F.col("low") != F.col("high")))
        large = materialise(large.withColumn("until", _common("low", "high")).drop("high"), "large")
        if not large.limit(1).count():
            ready.append(keyed)
            break
        known = keyed.join(large.select("key", "until", "least_all"), "key", "left")
        ready.append(known.where("until is null"))
        split = materialise(known.where("until is not null"), "split")
        ends = split.where("turns = until").select("key", "ends")  # at most one path of each
        chains.append(large.join(ends, "key", "left").select("key", F.col("from").alias("base"), F.col("above").alias("parent"), F.col("over").alias("up"), "until", F.col("n_all").alias("n"), F.col("least_all").alias("least"), F.substring(F.col("low"), F.lit(1), (F.col("until") * TURN).cast("int")).alias("low"), F.coalesce("ends", F.lit(_NONE)).alias("ends")))
        left = split.where("turns > until").select("path", "turns", "n", "least", "ends", F.col("until").alias("base"), F.col("least_all").alias("parent"), F.col("key").alias("up"))
    columns = ["key", "base", "parent", "up", "path", "n", "least", "ends"]
    built = ready[0].select(*columns)
    for more in ready[1:]:
        built = built.unionByName(more.select(*columns))
    dealt = built.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).drop("key")
    nodes = [materialise(dealt.groupBy("bucket").applyInPandas(forest, f"{NODE}, up binary"), "nodes")]
    for chain in reversed(chains):
        nodes.append(materialise(_chains(chain.join(_below(*nodes), "key")), "chains"))
    top = _below(*nodes).where(F.col("key") == root).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("below", "below_leaves", "below_saved")))
    one = top.select(F.lit(whole["least"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n"]).alias("n_convs"), F.col("below").alias("n_children"), F.greatest("below_leaves", F.lit(1)).alias("n_leaves"), F.col("below_saved").alias("saved_tokens"), F.lit(whole["ends"] or _NONE).alias("ends_sha256"))
    for part in nodes:
        one = one.unionByName(part.select(*NAMES))
    return one


def _common(low: str, high: str) -> Column:
    """Whole turns in which two paths agree."""

    @F.pandas_udf("long")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            size, step = 0, 1 << max(len(x), len(y)).bit_length()
            while step:  # the longest common beginning by halving steps
                if size + step <= min(len(x), len(y)) and x[size : size + step] == y[size : size + step]:
                    size += step
                step >>= 1
            out.append(size // TURN)
        return pd.Series(out, dtype="int64")

    return agree(F.col(low), F.col(high))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as `rebuilt` puts them together."""
    return trie(rebuilt(paths_of(conversations)))
