"""Removal of long repeated byte strings by a run-length index.

A string of `length` bytes repeats if it also starts anywhere else in the corpus, in the same document or another. Every
byte that some repeating string covers is removed; matches never cross documents and are judged on the input.

1. Anchors. In each window of `length` bytes one substring of ANCHOR bytes, the one of least hash (leftmost of equals), is
   its anchor. Equal windows have equal anchors at equal places, so a window can only repeat if its anchor's hash occurs
   more than once. Windows that share an anchor are a segment: at most 2 * length - ANCHOR bytes.
2. Repeated anchors are counted by Spark. Up to BITS / BITS_EACH of them are told to the second scan by a bitmap of that
   many bits at most; beyond, documents are joined to their own repeated anchors. A wrong bit costs a needless segment,
   never a miss.
3. Index. Segments go to tasks by anchor. A task takes whole anchors up to INDEX_BYTES of distinct segments and builds the
   Burrows-Wheeler transform of their concatenation, run-length compressed, with text positions sampled at the run ends.
   Within a run a neighbour match only grows by the character before it, so match lengths are measured at run ends alone
   and stream from there: each position's longest match with another is the running maximum. Windows with a match of
   `length` or more, and all windows of segments that occur more than once, repeat.
   An anchor with more segments than a task may hold is split first: each of its segments is cut again by anchors twice as
   long, which again stand at equal places of equal windows, and what is still too large once more, at last by whole
   windows, of which all are equal. So every anchor goes through the index, in parts.
4. Each document's marked ranges are united and cut out.

Defined cases: null and empty texts, and texts shorter than `length`, lose nothing; of repeated rows each occurrence makes
the others repeat, so all lose all windows; rows with a null doc_id count like others; an empty table gives no rows; very
long texts are cut into segments in pieces of PIECE bytes; other columns are ignored. Cutting may split a character: kept
bytes are bytes, `remove` gives text with broken characters dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import materialise, slices, text_key

LENGTH, ANCHOR = 200, 64
INDEX_BYTES, GROUP_BYTES = 1_500_000, 4_000_000
REMEMBERED = 300_000
PIECE = 2_000_000
BITS, BITS_EACH = 1 << 28, 8
PLACE = np.uint64((1 << 24) - 1)

_R = 0xD1342543DE82EF95
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") | 1 for b in range(256)], dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        ones = np.ones(n + n // 2, dtype=np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = _R, pow(_R, -1, 2**64)
        _powers[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0][0][:n], _powers[0][1][:n]


def hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each substring of `width` bytes."""
    up, down = _power(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up, dtype=np.uint64)])
    out = (sums[width:] - sums[:-width]) * down[: len(raw) - width + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all texts: each segment's anchor hash, text number, first and last window start (in the returned concatenation)."""
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    parts = []
    raw = np.frombuffer(whole, dtype=np.uint8)
    span = length - anchor + 1
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        piece = raw[at : at + PIECE + length - 1]
        full = hashes(piece, anchor)
        least = (full & ~PLACE) | np.arange(len(full), dtype=np.uint64)  # hash first, then place: the leftmost of equals
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & PLACE).astype(np.int64)
        start = np.arange(at, at + len(place))
        owner = np.searchsorted(begins, start, side="right") - 1
        inside = start + length <= begins[owner] + sizes[owner]
        start, owner, place = start[inside], owner[inside], place[inside]
        if len(start):
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(start)]]) - 1
            chosen = full[place[first]] * np.uint64(_R)  # the least hashes have no high bits left: spread them again
            parts.append((chosen ^ (chosen >> np.uint64(32)), owner[first], start[first], start[last]))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), whole
    return *(np.concatenate([p[k] for p in parts]) for k in range(4)), whole


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of texts, with positions sampled at the run ends."""

    def __init__(self, texts: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        n = len(self.text)
        padded = np.concatenate([self.text.astype(np.uint64), np.zeros(8, np.uint64)])
        self.eight = np.zeros(n, dtype=np.uint64)  # the eight bytes from each position on
        for k in range(8):
            self.eight = (self.eight << np.uint64(8)) | padded[k : k + n]
        key, depth = self.eight, 8
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            if rank[order[-1]] == n:
                break
            after = np.zeros(n, dtype=np.int64)
            if depth < n:
                after[: n - depth] = rank[depth:]
            key = rank * (n + 1) + after
            depth *= 2
        before = self.text[order - 1].astype(np.int16)
        before[order == 0] = -1  # the first suffix has no character before it
        ends = np.flatnonzero(before[1:] != before[:-1])
        self.heads = np.concatenate([[0], ends + 1])  # the runs: where they begin, and their characters
        self.letters = before[self.heads]
        self.upper, self.lower = order[ends], order[ends + 1]  # text positions sampled at run ends and the next run heads

    def count(self, pattern: bytes) -> int:
        """How often a pattern occurs, by backward search over the runs alone."""
        n = len(self.text)
        sizes = np.diff(np.append(self.heads, n))
        lo, hi = 0, n + 1  # rows of the transform with the end of the text as the first one
        for c in reversed(pattern):
            own = np.flatnonzero(self.letters == c)
            upto = np.concatenate([[0], np.cumsum(sizes[own])])
            last = int(self.text[-1] == c)
            below = 1 + int(sizes[(self.letters >= 0) & (self.letters < c)].sum()) + int(self.text[-1] < c)

            def rank(i: int, own=own, upto=upto, last=last) -> int:
                if i == 0 or not len(own):
                    return last if i else 0
                k = int(np.searchsorted(self.heads[own], i - 1))  # runs of c that begin before row i - 1
                return last + (int(upto[k - 1]) + min(int(sizes[own[k - 1]]), i - 1 - int(self.heads[own[k - 1]])) if k else 0)

            lo, hi = below + rank(lo), below + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes at a and at b, eight bytes at a time."""
        n = len(self.text)
        out = np.zeros(len(a), dtype=np.int64)
        most = n - np.maximum(a, b)
        going = np.flatnonzero(most > 0)
        while len(going):
            at = out[going]
            apart = self.eight[a[going] + at] ^ self.eight[b[going] + at]
            same = np.zeros(len(going), dtype=np.int64)
            for k in range(8):
                same += (apart >> np.uint64(56 - 8 * k)) == 0
            out[going] += same
            going = going[(same == 8) & (out[going] < most[going])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that also starts elsewhere."""
        reach = np.zeros(len(self.text), dtype=np.int64)
        length = self.common(self.upper, self.lower)
        np.maximum.at(reach, self.upper, self.upper + length)
        np.maximum.at(reach, self.lower, self.lower + length)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)


def _ranges(repeats: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows at the marked starts cover, one for each run of starts."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeats.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def mark(group: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """For distinct segments (anchor, hash, count, bytes), whole anchors only: (anchor, hash, start, end) of repeats."""
    out, mixed = [], []
    alone: dict[int, int] = {}
    for a, *_ in group:
        alone[a] = alone.get(a, 0) + 1
    for a, h, count, seg in group:
        if count > 1:
            out.append((a, h, 0, len(seg)))
        if alone[a] > 1:
            mixed.append((a, h, count, seg))
    if len(mixed) > 1:
        found = RunLengthIndex([seg for *_, seg in mixed]).matching_statistics() >= length
        at = 0
        for a, h, count, seg in mixed:
            if count == 1:
                out.extend((a, h, x, y) for x, y in _ranges(found[at : at + len(seg) - length + 1], length))
            at += len(seg) + 1
    return out


def _bitmap(hashed: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes' highest bits; its size does not depend on their number."""
    chunk = min(bits, 1 << 19)
    shift = 64 - (bits.bit_length() - 1)
    slots = hashed.select(F.shiftrightunsigned("anchor", shift).alias("slot")).withColumn("chunk", F.floor(F.col("slot") / chunk).cast("int"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plane = None, None
        for batch in batches:
            ids, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(ids).tolist():
                if c != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "plane": [np.packbits(plane).tobytes()]})
                    now, plane = c, np.zeros(chunk, dtype=bool)
                plane[slot[ids == c] % chunk] = True
        if now is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "plane": [np.packbits(plane).tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    rows = slots.select("chunk", "slot").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk int, plane binary")
    for r in rows.toLocalIterator():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["plane"], dtype=np.uint8)
    return out


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, most_bits: int = BITS) -> DataFrame:
    """(doc_id, text_key, ranges): for each text that has any, the byte ranges of repeats (to be united)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.octet_length("text") >= length).select("doc_id", "text", text_key(F.col("text")).alias("text_key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n = np.unique(segments(batch.column(0).cast(pa.binary()).to_pylist(), length, anchor)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    counted = rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = materialise(counted.where("n > 1").select("anchor"), "anchors")
    total = repeated.count()
    if total * BITS_EACH <= most_bits:
        bits = 1 << 20
        while bits < most_bits and bits < 2 * BITS_EACH * total:
            bits *= 2
        shared = spark.sparkContext.broadcast(_bitmap(repeated, bits))
        shift = np.uint64(64 - (bits.bit_length() - 1))

        def by_bitmap(batch: pa.RecordBatch, hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
            slot = (hashed >> shift).astype(np.int64)
            return np.flatnonzero((shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)

        emitted = rows.mapInArrow(_emitter(by_bitmap, length, anchor), _segment_schema(kind))
    else:

        def own_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hashed, owner, *_ = segments(batch.column(1).cast(pa.binary()).to_pylist(), length, anchor)
                place = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(2).take(place), pa.array(hashed.view(np.int64))], names=["doc_id", "text_key", "anchor"])

        own = rows.mapInArrow(own_anchors, f"doc_id {kind}, text_key long, anchor long").join(repeated, "anchor", "left_semi")
        own = own.groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))  # a document's own, no more than its length allows
        a, b = rows.alias("a"), own.alias("b")
        joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))).select("a.doc_id", "a.text", "a.text_key", "b.anchors")

        def by_list(batch: pa.RecordBatch, hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
            lists = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column(3).to_pylist()]
            edges = np.searchsorted(owner, np.arange(len(lists) + 1))
            return np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(np.isin(hashed[x:y], own)) + x for own, x, y in zip(lists, edges[:-1], edges[1:], strict=True))])

        emitted = joined.mapInArrow(_emitter(by_list, length, anchor), _segment_schema(kind))
    found = materialise(emitted, "segments")
    places, segs = found.where("at is not null").select("anchor", "hash", "doc_id", "text_key", "at"), found.where("n is not null").select("anchor", "hash", "n", "seg")
    marks = _marks(segs, length, anchor, group_bytes)
    spread = places.join(marks, ["anchor", "hash"]).select("doc_id", "text_key", F.struct((F.col("at") + F.col("x")).alias("x"), (F.col("at") + F.col("y")).alias("y")).alias("range"))
    return spread.groupBy("doc_id", "text_key").agg(F.collect_list("range").alias("ranges"))


def _segment_schema(kind: str) -> str:
    return f"anchor long, hash long, doc_id {kind}, text_key long, at long, n long, seg binary"


def _emitter(chosen: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], length: int, anchor: int):
    """Of (doc_id, text, text_key): a row for each place of a chosen segment, and rows with the segments' bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in slices(batches):
            if len(told) > REMEMBERED:
                told.clear()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            hashed, owner, first, last, whole = segments(texts, length, anchor)
            wanted = chosen(batch, hashed, owner)
            begins = np.cumsum([0] + [len(t) for t in texts])
            local: dict[tuple[int, int], list] = {}
            marks = []
            for a, d, x, y in zip(hashed[wanted].view(np.int64).tolist(), owner[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                seg = whole[x : y + length]
                h = xxhash.xxh3_64_intdigest(seg) - 2**63
                marks.append((a, h, d, x - begins[d]))
                if (a, h) in local:
                    local[a, h][0] += 1
                else:
                    local[a, h] = [1, None if (a, h) in told else seg]  # a task sends a segment's bytes once
                    told.add((a, h))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, *_ in marks] + [a for a, _ in local], pa.int64()),
                    pa.array([h for _, h, *_ in marks] + [h for _, h in local], pa.int64()),
                    pa.concat_arrays([batch.column(0).take(pa.array([d for _, _, d, _ in marks], pa.int64())), pa.nulls(len(local), batch.column(0).type)]),
                    pa.concat_arrays([batch.column(2).take(pa.array([d for _, _, d, _ in marks], pa.int64())), pa.nulls(len(local), pa.int64())]),
                    pa.array([x for *_, x in marks] + [None] * len(local), pa.int64()),
                    pa.array([None] * len(marks) + [c for c, _ in local.values()], pa.int64()),
                    pa.array([None] * len(marks) + [s for _, s in local.values()], pa.binary()),
                ],
                names=["anchor", "hash", "doc_id", "text_key", "at", "n", "seg"],
            )

    return emit


def _marks(segs: DataFrame, length: int, anchor: int, group_bytes: int) -> DataFrame:
    """(anchor, hash, x, y): repeats in each distinct segment; anchors beyond group_bytes are split by longer ones first."""
    if anchor >= length:  # a segment is one window, so an anchor has one
        return _index(segs, length)
    large = segs.groupBy("anchor").agg(F.coalesce(F.sum(F.length("seg")), F.lit(0)).alias("total")).where(F.col("total") > group_bytes).select("anchor")
    large = materialise(large, "large")
    if not large.limit(1).count():
        return _index(segs, length)
    longer = min(length, 2 * anchor)
    distinct = segs.join(large, "anchor", "left_semi").groupBy("anchor", "hash").agg(F.sum("n").alias("n"), F.first("seg", ignorenulls=True).alias("seg"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seg"):
            hashed, owner, first, last, whole = segments(batch.column(3).to_pylist(), length, longer)
            begins = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(3)).to_numpy())]).astype(np.int64)
            subs = [whole[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            place = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(place), batch.column(1).take(place), pa.array(first - begins[owner]), pa.array(hashed.view(np.int64)), pa.array([xxhash.xxh3_64_intdigest(x) - 2**63 for x in subs], pa.int64()), batch.column(2).take(place), pa.array(subs, pa.binary())],
                names=["anchor", "hash", "at", "part", "part_hash", "n", "seg"],
            )

    parts = materialise(distinct.select("anchor", "hash", "n", "seg").mapInArrow(split, "anchor long, hash long, at long, part long, part_hash long, n long, seg binary"), "parts")
    found = _marks(parts.select(F.col("part").alias("anchor"), F.col("part_hash").alias("hash"), "n", "seg"), length, longer, group_bytes)
    found = found.select(F.col("anchor").alias("part"), F.col("hash").alias("part_hash"), "x", "y")
    moved = parts.select("anchor", "hash", "at", "part", "part_hash").join(found, ["part", "part_hash"]).select("anchor", "hash", (F.col("at") + F.col("x")).alias("x"), (F.col("at") + F.col("y")).alias("y"))
    return _index(segs.join(large, "anchor", "left_anti"), length).unionByName(moved)


def _index(segs: DataFrame, length: int) -> DataFrame:
    """(anchor, hash, x, y): repeats in each distinct segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[list] = []
        size = 0

        def flush() -> pa.RecordBatch:
            got = mark([tuple(g) for g in group], length)
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(4)], names=["anchor", "hash", "x", "y"])

        for batch in batches:
            for a, h, n, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:2] == [a, h]:
                    group[-1][2] += n
                    group[-1][3] = group[-1][3] or seg
                    continue
                if size >= INDEX_BYTES and group[-1][0] != a:
                    yield flush()
                    group, size = [], 0
                group.append([a, h, n, seg])
                size += 2 * length
        if group:
            yield flush()

    spark = segs.sparkSession
    n = max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return segs.repartition(n, "anchor").sortWithinPartitions("anchor", "hash").mapInArrow(run, "anchor long, hash long, x long, y long")


def _united(ranges: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["x"], r["y"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(raw: bytes, ranges: list[list[int]]) -> bytes:
    kept, last = [], 0
    for a, b in ranges:
        kept.append(raw[last:a])
        last = b
    return b"".join([*kept, raw[last:]])


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    """One struct column `row` of docs' columns, beside `text` and `ranges`."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", text_key(F.col("text")).alias("text_key")).alias("d")
    found = repeated_ranges(docs.select("doc_id", "text"), length).alias("r")
    return rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key")), "left").select("d.row", "d.doc_id", "d.text", "r.ranges")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for raw, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, united = raw or b"", _united(ranges)
                for column, value in zip(out, (len(raw), sum(b - a for a, b in united), len(united), hashlib.sha256(_cut(raw, united)).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs.select("doc_id", "text"), length).select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with their own columns, without repeated strings; characters that a cut splits are dropped."""
    marked = _with_ranges(docs, length).select("row", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            texts = [None if r is None else _cut(r, _united(s)).decode(errors="ignore") for r, s in zip(raws, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    cut = marked.mapInArrow(run, StructType([marked.schema["row"], StructField("text", StringType())]))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
