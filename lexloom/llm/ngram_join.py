"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class from the start. Of the rest:

1. Candidates. Two sets of Jaccard likeness t or more differ in few shingles: at most (x + y)(1 - t)/(1 + t), and at most
   x(1 - t)/t. A set's hash range is cut into more parts than that, so the sets agree on all shingles of most parts. Each
   part's hash is a signature. All parts stand in one order, those with most shingles first and then by their hash, so of
   two sets that differ in at most d parts, each has one among its first d + 1 that the other has there too: only these are
   sent. Parts of one shingle, which texts with a passage in common share by the thousand, come last and mostly stay at home.
   Sets that share a signature get the smallest class among them as their leader. Parts are counted by bands of set
   sizes, and a set near the top of its band also stands in the next one. No pairs are made: a leader and its followers
   are a group, and two linked sets meet in at least one group.
2. Groups. A group is opened in one task. A large one is a star first: every set is compared with one of them, and only
   what is not linked with that goes on, so a text's near copies are sent once each (`tasks_of`); in what remains large
   after some rounds every two blocks of sets meet in a task. First only shapes are sent: counts of a set's shingles in
   SHAPE ranges of the hash. Shapes that differ by more than two linked sets can rule a pair out, and a box around the
   shapes of a small group rules out all of it at once. Texts follow only for sets that still have a possible partner.
3. Token-group matrix. In a task similar-sized sets form small groups with the union of their shingles. A set's overlap
   with a union bounds its overlap with each member, so only groups that can hold a partner are opened, and there the
   exact test is 100 * intersection >= 100 t * union. Links come out as a spanning forest of each task.
4. Components of the links are found by Spark joins.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; rows without doc_id link with nothing and have no component; repeated rows are copies of
each other; a likeness of just the threshold links; an empty table gives no rows; very long texts are read whole, one at
a time; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begins, keeps, materialise, rows_at_once, slices, text_key
from .components import connected

WORDS, PERCENT = 3, 90
BLOCK_SETS, BLOCK_SHINGLES, SUBGROUP = 512, 400_000, 16
SHAPE = 64
#: Bytes of a word that is hashed beside others, and of a text whose words are remembered; what a worker remembers.
LONG, SHORT, REMEMBERED = 32, 200, 200_000
#: Rows that Spark sends to Python at once: a batch of texts stands in both processes and, packed, between them.
AT_ONCE = 1_000
#: Signatures that a task looks at together, sets among them that make a signature common, and rounds of stars.
SIGNATURES, COMMON, STARS = 500_000, 64, 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NONE = np.zeros(0, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


#: Codes of words of short texts.
_words: dict[bytes, int] = {}
keeps("ngram_join", _words.clear)
#: Keeps the first 0 to 8 bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _codes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-case text, by eight bytes at a time of all words together; one longer than LONG bytes is hashed alone."""
    raw = np.frombuffer(text + bytes(8), dtype=np.uint8)
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[1:-8] = (raw[:-8] != 32) & (raw[:-8] - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=raw, strides=(1,))
    out = _mix((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _B)
    rest = np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        if not len(rest):
            return out
        out[rest] = _mix(out[rest] * _C + (eight[start[rest] + k] & _FIRST[np.minimum(size[rest] - k, 8)]))
        rest = rest[size[rest] > k + 8]
    for i in rest.tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
    return out


def _word_codes(text: bytes) -> np.ndarray:
    if len(text) > SHORT:
        return _codes(text)
    words = text.split()
    if not all(w in _words for w in words):
        if len(_words) >= REMEMBERED:
            _words.clear()
        _words.update(zip(words, _codes(text).tolist(), strict=True))
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text."""
    code = _word_codes(text.translate(_LOWER))
    if not len(code):
        return NONE
    n = max(1, len(code) - width + 1)
    out = code[:n]
    for k in range(1, min(width, len(code))):
        out = out * _C + code[k : k + n]
    out = _mix(_mix(out + np.uint64(min(width, len(code)))))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def key_of(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).astype(np.int64))


def shape_of(tokens: np.ndarray) -> bytes:
    """How many shingles fall in each of SHAPE ranges of the hash, at most 65535 each."""
    return np.minimum(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=SHAPE), 65535).astype("<u2").tobytes()


class Bands:
    """Bands of set sizes and their numbers of parts, for a likeness of percent / 100."""

    def __init__(self, percent: int = PERCENT, longest: int = 1 << 40):
        self.percent, self.t = percent, Fraction(percent, 100)
        self.starts = [max(1, int(self.t / (1 - self.t)))]  # below, only equal sets are alike enough
        # a band of ratio t**-m costs 1 + 1 / m stays of each set and parts for its largest set: take the cheapest m
        cost = {m: (1 + 1 / m) * (float(self.t) ** -m - 1) / m for m in range(1, 9)}
        power = min(cost, key=cost.get)
        while self.starts[-1] < longest:
            self.starts.append(int(-(-self.starts[-1] // self.t**power)) + 1)
        self.apart = [int(2 * (end - 1) * (1 - self.t) / (1 + self.t)) for end in self.starts[1:]]  # shingles that may differ
        self.parts = [self._parts(start, apart) for start, apart in zip(self.starts, self.apart, strict=False)]
        self._cuts: dict[int, np.ndarray] = {}

    @staticmethod
    def _parts(start: int, apart: int) -> int:
        """So many that a usual set of the band has more parts with shingles in them than shingles that may differ."""
        parts = apart + 1
        while parts * (1 - math.exp(-start / parts)) < 1.05 * (apart + 1):
            parts += 1 + parts // 50
        return parts

    def cuts(self, band: int) -> np.ndarray:
        """Where the parts of a band begin, but for the first."""
        if band not in self._cuts:
            parts = self.parts[band]
            self._cuts[band] = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        return self._cuts[band]

    def differ(self, n: int, band: int) -> int:
        """The most shingles in which a set of n and one that links with it in a band differ."""
        return min(self.apart[band], n * (100 - self.percent) // self.percent)

    def of(self, n: int) -> list[int]:
        """The band of a set of n, and the next one if a partner may stand there."""
        if n < self.starts[0]:
            return []
        band = int(np.searchsorted(self.starts, n, side="right")) - 1
        return [band, band + 1] if n >= self.t * self.starts[band + 1] else [band]


def signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """For each band of the set, hashes of the shingles in parts of the hash range: of so many parts that one is shared with each linked set."""
    out = []
    sums = None
    for band in bands.of(len(tokens)):
        if sums is None:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(tokens + _B), dtype=np.uint64)])
        at = np.concatenate([[0], np.searchsorted(tokens, bands.cuts(band)), [len(tokens)]])
        count = np.diff(at).astype(np.uint64)
        sig = _mix(sums[at[1:]] - sums[at[:-1]] + np.arange(len(count), dtype=np.uint64) * _C + np.uint64(band * int(_A) % 2**64) + count * _B)
        first = bands.differ(len(tokens), band) + 1
        if first < len(sig):
            place = (np.uint64(63) - np.minimum(count, np.uint64(63))) << np.uint64(58) | sig >> np.uint64(6)
            sig = sig[np.argpartition(place, first - 1)[:first]]
        out.append(sig)
    return np.concatenate(out) if out else NONE


def document_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, key (of the set; null if it is empty) and shape, in one scan."""
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("ngram_join")
        for batch in slices(batches):
            sets = [shingles(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([shape_of(s) for s in sets], pa.binary())], names=["doc_id", "text_key", "n_shingles", "key", "shape"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, key long, shape binary")


def candidates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(leader, key): each class with the smallest class that shares a signature with it.

    A signature that is common among the sets a task has seen sends one marker to the place where its leader is found; its
    sets are spread and learn their leader by a join afterwards, which Spark can split. So no task gets all sets of one signature.
    """

    def told_rows(sigs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        sig, key = np.concatenate([NONE, *sigs]), np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        common = np.repeat(size > COMMON, size)
        mark = first[size > COMMON]
        place = np.concatenate([sig[~common], sig[mark], _mix(sig[common] ^ _mix(key[common].view(np.uint64)))])
        who = np.concatenate([key[~common], key[mark], key[common]])
        told = np.concatenate([sig[~common], sig[mark], sig[common]])
        plain = np.arange(len(told)) < (~common).sum()
        return pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(who), pa.array(told.view(np.int64), mask=plain)], names=["place", "key", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("ngram_join")
        bands, told = Bands(percent), set()
        sigs, keys, size = [], [], 0
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                tokens = shingles(text, width)
                key = key_of(tokens)
                if key in told:  # a copy has nothing to add
                    continue
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add(key)
                sigs.append(signatures(tokens, bands))
                keys.append(np.full(len(sigs[-1]), key))
                size += len(keys[-1])
            if size >= SIGNATURES:
                yield told_rows(sigs, keys)
                sigs, keys, size = [], [], 0
        yield told_rows(sigs, keys)

    rows = docs.where("text is not null and doc_id is not null").select("text").mapInArrow(run, "place long, key long, sig long")
    kind = F.when(F.col("sig").isNull(), 0).when(F.col("sig") == F.col("place"), 1).otherwise(2)  # a set's, a marker, a spread set's
    led = rows.withColumn("leader", F.min("key").over(Window.partitionBy("place"))).withColumn("kind", kind).where("kind > 0 or leader <> key")
    found = materialise(led.select("leader", "key", "kind", "sig").distinct(), "signatures")
    pairs = found.where("kind < 2 and leader <> key").select("leader", "key")
    leaders = found.where("kind = 1").groupBy("sig").agg(F.min("leader").alias("leader"))
    if not leaders.limit(1).count():
        return pairs
    spread = found.where("kind = 2").select("sig", "key").join(leaders, "sig").where("leader <> key").select("leader", "key")
    return pairs.unionByName(spread).distinct()


TASK = ("leader", "x", "y")
_SET = ("key", "doc_id", "n", "shape")


def _blocks(members: DataFrame) -> DataFrame:
    """Each group with its number of blocks."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    return sizes.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")).drop("m", "total")


def _alone(members: DataFrame) -> DataFrame:
    """Groups of one block as tasks."""
    zero = F.lit(0)
    return members.select("leader", zero.alias("x"), zero.alias("y"), zero.alias("own"), *_SET)


def _named(rows: DataFrame, tag: str) -> DataFrame:
    """Tasks under names of their own."""
    return rows.withColumn("leader", F.xxhash64("leader", F.lit(tag)))


def tasks_of(docs: DataFrame, members: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame | None]:
    """members (leader, key, doc_id, n, shape) as tasks (leader, x, y, own, ...), and the links (a, b) found on the way.

    A group of more than one block is a star first, if more than a block of its sets may link with one of them, the pivot,
    by their shapes: these are compared with it. What links with the pivot is one component and needs no other comparison
    inside. 1 - likeness is a distance, so a set that is over twice the linking distance from the pivot links with none of
    those; what lies between meets them. The others are a group of their own, for which the same goes again. In groups that
    are no stars, and in what is left after STARS rounds, every two blocks meet, by their shapes first.
    """
    large = materialise(_blocks(members).where("blocks > 1"), "large")
    if not large.limit(1).count():
        return _alone(members), None
    out, found = _alone(members.join(large, "leader", "left_anti")), None
    rest = materialise(members.join(large, "leader", "left_semi").select("leader", *_SET), "rest")
    for k in range(STARS):
        shaped = materialise(_shaped(rest, percent), "shaped")
        stars = materialise(shaped.groupBy("leader").agg(F.count(F.when(F.col("state") == 0, 1)).alias("like")).where(F.col("like") > BLOCK_SETS).select("leader"), "stars")
        if not stars.limit(1).count():
            break
        out = out.unionByName(_named(_met(shaped.join(stars, "leader", "left_anti").select("leader", *_SET)), f"no star {k}"))
        shaped = shaped.join(stars, "leader", "left_semi")
        judged = materialise(_judged(docs, shaped.where("state < 2"), width, percent), "judged")
        linked = judged.where("state = 0 and key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
        found = linked if found is None else found.unionByName(linked)
        out = out.unionByName(_named(_between(judged), f"between {k}"))
        loose = judged.where("state > 0").select("leader", *_SET).unionByName(shaped.where("state = 2").select("leader", *_SET))
        large = materialise(_blocks(loose).where("blocks > 1"), "large")
        out = out.unionByName(_named(_alone(loose.join(large, "leader", "left_anti")), f"left {k}"))
        if not large.limit(1).count():
            return out, found
        rest = materialise(loose.join(large, "leader", "left_semi"), "rest")
    return out.unionByName(_named(_met(rest), "met")), found


def _met(members: DataFrame) -> DataFrame:
    """Tasks in which every two blocks of a group meet."""
    dealt = members.join(_blocks(members), "leader").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    return dealt.select(*TASK, "own", *_SET)


def _shaped(members: DataFrame, percent: int) -> DataFrame:
    """members with the pivot of their group (its smallest class) and the state that their shapes leave open: 0 may link with it, 1 may be near, 2 is far."""
    pivots = members.groupBy("leader").agg(F.min_by(F.struct("key", "n", "shape"), "key").alias("p"))

    @F.pandas_udf("int")
    def apart(mine: pd.Series, pivot: pd.Series) -> pd.Series:
        cells = lambda column: np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, SHAPE).astype(np.int32)
        return pd.Series(np.abs(cells(mine) - cells(pivot)).sum(axis=1), dtype="int32")

    rows = members.join(pivots, "leader").withColumn("apart", apart("shape", "p.shape"))
    n, m = F.col("n"), F.col("p.n")
    may = lambda share: (F.col("apart") * (100 + share) <= (100 - share) * (n + m)) & (F.least(n, m) * 100 >= F.greatest(n, m) * share)
    return rows.select("leader", *_SET, F.col("p.key").alias("pivot"), F.when(may(percent), 0).when(may(max(0, 2 * percent - 100)), 1).otherwise(2).alias("state"))


def _between(judged: DataFrame) -> DataFrame:
    """Tasks in which the sets near a star meet those that are linked with its pivot, block by block."""
    near = judged.where("state < 2")
    side = lambda state, name: _blocks(near.where(F.col("state") == state)).withColumnRenamed("blocks", name)
    dealt = near.join(side(0, "inner"), "leader").join(side(1, "outer"), "leader")
    first = F.col("state") == 0
    own = F.when(first, F.pmod(F.xxhash64("key"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("key"), F.col("outer"))).cast("int")
    other = F.when(first, F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("inner") - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other))
    return dealt.select("leader", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *_SET)


def _judged(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """members (with pivot) and their true state: 0 linked with the pivot, 1 near, 2 far."""
    parts = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    first = F.col("key") == F.col("pivot")
    dealt = members.select("leader", "pivot", *_SET).join(_blocks(members), "leader")
    dealt = dealt.withColumn("own", F.explode(F.when(first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))))
    wanted = dealt.groupBy("doc_id", "key").agg(F.collect_list(F.struct("leader", "own", first.alias("first"))).alias("stays"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(materialise(wanted, "wanted"), "doc_id")
    rows = texts.select("doc_id", "key", "text", F.explode("stays").alias("s")).select("s.*", "doc_id", "key", "text")
    rows = rows.repartition(parts, "leader", "own").sortWithinPartitions("leader", "own", F.desc("first"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("ngram_join")
        now, pivot, name, last = None, NONE, None, None
        for batch in slices(batches):
            out: list[tuple] = []
            for leader, own, is_pivot, doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leader, own) != now:
                    now, name, last = (leader, own), None, None
                tokens = shingles(text.encode(), width)
                if key == last or key_of(tokens) != key:  # doc_id may stand for another text too, or twice for this one
                    continue
                last = key
                if is_pivot:
                    pivot, name = tokens, key
                    if own:
                        continue
                shared = len(tokens) + len(pivot) - len(np.union1d(tokens, pivot))
                union = len(tokens) + len(pivot) - shared
                state = 0 if 100 * shared >= percent * union else 1 if 100 * shared >= (2 * percent - 100) * union else 2
                out.append((leader, name, key, doc_id, len(tokens), shape_of(tokens), state))
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["leader", "pivot", "key", "doc_id", "n", "shape", "state"])

    return rows.mapInArrow(run, "leader long, pivot long, key long, doc_id long, n long, shape binary, state int")


def links(docs: DataFrame, sets: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between classes (keys) of different sets, as spanning forests of the tasks that found them."""
    pairs = materialise(candidates(docs, width, percent), "leaders")
    members = pairs.union(pairs.select("leader", F.col("leader").alias("key"))).distinct()
    classes = sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").cast("long").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("shape").alias("shape"))
    sent, found = tasks_of(docs, members.join(classes, "key"), width, percent)
    parts = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sent = sent.select(*TASK, "own", "key", "doc_id", "n", "shape").repartition(parts, *TASK).sortWithinPartitions(*TASK, "n", "key")
    left = materialise(sent.mapInArrow(_sifter(percent), "leader long, x int, y int, own int, key long, doc_id long"), "tasks")
    wanted = left.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*TASK, "own")).alias("tasks"))
    # a merge join at every size: the wanted ids grow with the documents, so no plan should count on broadcasting them
    texts = docs.where("text is not null").select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("text", "key", F.explode("tasks").alias("t"))
    rows = texts.select("t.*", "key", "text").repartition(parts, *TASK).sortWithinPartitions(*TASK, "key").select(*TASK, "own", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("ngram_join")
        now, found = None, {}
        for batch in slices(batches):
            for leader, x, y, own, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leader, x, y) != now:
                    yield _edges(_open(found, now, percent))
                    now, found = (leader, x, y), {}
                if key not in found:
                    tokens = shingles(text.encode(), width)
                    if key_of(tokens) == key:  # doc_id may stand for another text too
                        found[key] = (own, tokens)
        yield _edges(_open(found, now, percent))

    opened = rows.mapInArrow(run, "a long, b long")
    return (opened if found is None else opened.unionByName(found)).distinct()


def _sifter(percent: int):
    """Of each task's sets (sorted by size), those that may link with another by their shapes."""

    def sift(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        shapes = np.frombuffer(b"".join(r[7] for r in rows), dtype="<u2").reshape(-1, SHAPE).astype(np.int32)
        sizes = np.array([r[6] for r in rows], dtype=np.int64)
        own = np.array([r[3] for r in rows])
        starts = np.arange(0, len(rows), SUBGROUP)
        high, low = np.maximum.reduceat(shapes, starts), np.minimum.reduceat(shapes, starts)
        most = sizes[np.minimum(starts + SUBGROUP, len(rows)) - 1]
        keep = np.zeros(len(rows), dtype=bool)
        across = rows[0][1] != rows[0][2]
        for q in range(1, len(rows)):
            n, mine = int(sizes[q]), shapes[q]
            last = q // SUBGROUP + 1  # partners come before q in order of size, so their groups do too
            first = int(np.searchsorted(100 * most[:last], percent * n))
            if last - first > 2:
                box = np.maximum(low[first:last] - mine, mine - high[first:last]).clip(0).sum(axis=1)
                near = np.flatnonzero((100 + percent) * box <= (100 - percent) * 2 * n) + first
            else:
                near = np.arange(first, last)
            at = (near[:, None] * SUBGROUP + np.arange(SUBGROUP)).ravel()
            at = at[at < q]
            apart = np.abs(shapes[at] - mine).sum(axis=1)
            ok = ((100 + percent) * apart <= (100 - percent) * (n + sizes[at])) & (100 * sizes[at] >= percent * n)
            if across:
                ok &= own[at] != own[q]
            if ok.any():
                keep[at[ok]] = True
                keep[q] = True
        return [r[:6] for r, k in zip(rows, keep.tolist(), strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        now: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    out += sift(rows)
                    now, rows = row[:3], []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["leader", "x", "y", "own", "key", "doc_id"])
        out = sift(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["leader", "x", "y", "own", "key", "doc_id"])

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _open(found: dict, task: tuple | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one task: within a block, or between two blocks."""
    if len(found) < 2:
        return []
    keys = sorted(found, key=lambda k: (len(found[k][1]), k))
    owner = [found[k][0] for k in keys]
    sizes = np.array([len(found[k][1]) for k in keys])
    _, ids = np.unique(np.concatenate([found[k][1] for k in keys]), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    width = int(ids.max()) + 1
    starts = list(range(0, len(keys), SUBGROUP))
    matrix = np.zeros((len(starts), width), dtype=bool)  # the token-group matrix
    for g, s in enumerate(starts):
        matrix[g, ids[begins[s] : ends[min(s + SUBGROUP, len(keys)) - 1]]] = True
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, mark = [], np.zeros(width, dtype=bool)
    across = task is not None and task[1] != task[2]
    least, most = sizes[starts], sizes[[min(s + SUBGROUP, len(keys)) - 1 for s in starts]]
    for q in range(len(keys)):
        own = ids[begins[q] : ends[q]]
        n = len(own)
        # partners before q in order of size: no smaller than t * n, and overlap >= t / (1 + t) * (n + partner)
        far = np.array(starts) < q
        ready = np.flatnonzero(far & (100 * most >= percent * n))
        if not len(ready):
            continue
        bound = matrix[ready][:, own].sum(axis=1)
        ready = ready[(100 + percent) * bound >= percent * (n + np.maximum(least[ready], -(-percent * n // 100)))]
        if not len(ready):
            continue
        mark[own] = True
        for g in ready.tolist():
            a, b = starts[g], min(starts[g] + SUBGROUP, q)
            shared = np.add.reduceat(mark[ids[begins[a] : ends[b - 1]]], begins[a:b] - begins[a], dtype=np.int64)
            union = n + sizes[a:b] - shared
            for m in np.flatnonzero(100 * shared >= percent * union).tolist():
                m += a
                if (not across or owner[m] != owner[q]) and root(m) != root(q):
                    parent[root(q)] = root(m)
                    out.append((keys[m], keys[q]))
        mark[own] = False
    return out


def _classes(sets: DataFrame) -> DataFrame:
    return sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"))


def _joined(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the least doc_id of each class that links with another."""
    classes = _classes(sets)
    pairs = links(docs, sets, width, percent)
    return connected(pairs.join(classes.select(F.col("key").alias("a"), F.col("least").alias("x")), "a").join(classes.select(F.col("key").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, key and component_id of every row."""
    with rows_at_once(docs.sparkSession, AT_ONCE):
        sets = materialise(document_sets(docs, width), "sets")
        joined = _joined(docs, sets, width, percent)
    classes = _classes(sets)
    by_class = classes.join(joined, classes["least"] == joined["node"], "left").select("key", F.coalesce("component", "least").alias("component"))
    return sets.join(by_class, "key", "left").select("doc_id", "text_key", "n_shingles", "key", F.when(F.col("key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with their own columns, that have the least doc_id of their component; all that link with nothing.

    Of repeated rows (equal doc_id and text, with any words) one stays: the one whose columns have the least hash.
    """
    found = materialise(components(docs, width, percent), "components")
    single = found.where("key is not null and doc_id is not null")
    stay = single.where("doc_id = component_id").groupBy("doc_id", "key").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key").distinct()
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row__"), "doc_id", text_key(F.col("text")).alias("text_key"))
    linked = rows.join(stay, ["doc_id", "text_key"])
    first = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("row__")))
    kept = linked.withColumn("first__", first).where("first__ = 1").select("row__.*")
    loose = rows.where(F.col("doc_id").isNull()).select("row__.*")
    empty = rows.where("doc_id is not null").join(found.where("key is null and doc_id is not null").select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_semi").select("row__.*")
    return kept.unionByName(loose).unionByName(empty).select(*names)
