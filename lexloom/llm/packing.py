"""Best-fit packing with Martello and Toth's dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` of them, so the whole table is packed by its histogram:
dominance first fixes sets that some best packing has, then best-fit-decreasing places the rest, many equal bins at once.
The plan is a short list of bin patterns however many documents there are. Each piece then finds its place by its rank
among the pieces of its length; ranks come from salted groups, so a length that a third of all pieces share is no hot
group.

Defined cases: null and empty texts have the end id only; a document longer than the capacity is cut into full pieces and
a rest, however long it is; repeated rows are packed each; of pieces of one length any may take any place, ordered by
doc_id, piece and sum of ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .tokens import coder, vocabulary_path

CAPACITY, END_ID = 2048, 0
SALT_ROWS = 20_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # bins, and in each of them (length, copies)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Take from counts the sets that dominate every other set with their largest item, and return them as patterns.

    For a length j and the largest k that fits beside it: alone if nothing fits; {j, k} if they fill the bin, or if no two
    further items fit beside j.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            if not counts.get(j):
                continue
            counts[j] -= 1  # one of j is placed; what is left may go beside it
            left = sorted(x for x in counts if counts[x])
            counts[j] += 1
            room = capacity - j
            at = bisect_left(left, room + 1) - 1
            if at < 0:
                fixed.append((counts.pop(j), ((j, 1),)))
                changed = True
                continue
            k = left[at]
            smallest = left[0] * 2 if counts[left[0]] - (left[0] == j) > 1 else left[0] + (left[1] if len(left) > 1 else capacity)
            if k != room and smallest <= room:
                continue
            bins = counts[j] // 2 if k == j else min(counts[j], counts[k])
            if not bins:
                continue
            fixed.append((bins, ((j, 2),) if k == j else ((j, 1), (k, 1))))
            for x in (j, k):
                counts[x] -= bins
            for x in {j, k}:
                if not counts[x]:
                    del counts[x]
            changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit-decreasing: each length goes to the fullest bins with room for it, equal bins together."""
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(pattern)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            bins, items = open_bins[room].pop() if at < len(rooms) else (n, ())
            if at < len(rooms) and not open_bins[room]:
                del open_bins[room], rooms[at]
            each = room // size
            if n < each:
                used, each = 1, n
            else:
                used = min(bins, n // each)
            n -= used * each
            put(room - each * size, (used, (*items, (size, each))))
            if items and bins > used:
                put(room, (bins - used, items))
    return [p for room in rooms for p in open_bins[room]]


class Plan:
    """For each length and rank: the sequence and the offset in it."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        left = dict(counts)
        patterns = reduce_by_dominance(left, capacity) + best_fit(left, capacity)
        self.sequences = sum(bins for bins, _ in patterns)
        rows, used, first = [], dict.fromkeys(counts, 0), 0
        for bins, items in patterns:
            offset = 0
            for size, copies in items:
                rows.append((size, used[size], first, copies, offset))
                used[size] += bins * copies
                offset += size * copies
            first += bins
        if used != counts:
            raise AssertionError("a plan must place every piece once")
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 48) | table[:, 1]
        self.rank, self.first, self.copies, self.offset = table[:, 1:].T.copy() if len(table) else np.zeros((4, 0), dtype=np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        inside = rank - self.rank[at]
        return self.first[at] + inside // self.copies[at], self.offset[at] + inside % self.copies[at] * length


def pieces_of(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or vocabulary_path()
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = coder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type if k == 0 else kinds[k]) for k, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """pieces_of with sequence_id and offset."""
    pieces = materialise(pieces_of(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    salts = F.lit([1 + counts.get(length, 0) // SALT_ROWS for length in range(1, capacity + 1)])  # only common lengths are salted
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int"))))
    group = ["length", "salt"]
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("inside", inside).join(offsets, group).withColumn("rank", F.col("before") + F.col("inside") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = shared.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x) for x in where)], names=[*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
