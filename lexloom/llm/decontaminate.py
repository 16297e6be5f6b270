"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every document.

Words are the runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A window is `width`
consecutive words of an item; an item of fewer words (but not none) is one window. Defined cases:

* null or empty text, or a text without words: no hits;
* an item without words has no window; rows with equal item_id count as one item; an item whose id is null marks
  words but is not listed;
* repeated documents are each judged; columns beyond doc_id and text are ignored by `find_hits`, kept by `drop_contaminated`;
* an empty benchmark leaves every document clean, an empty table of documents gives no rows;
* overlapping hits count once; an item that occurs many times in a document, or by several windows, is listed once;
* very long texts are scanned whole, one at a time.

The benchmark is broadcast in parts of at most `part_chars` characters (or one longer bucket of items). One part is the
usual case: the corpus is read once and nothing is shuffled. A larger benchmark takes a job for each part, one after the
other, so a task has one Python worker with one part at a time however large the benchmark is; a job writes the hits of
texts alone, by the texts' digests, and the last part's scan takes them in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

WIDTH = 10
PART_CHARS = 8_000_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_TABLE).split()


class WindowIndex:
    """The windows of one part of the benchmark: by length, sorted hashes with the place of each window and its items.

    A window is kept as its place among the items' words, so an index takes some 30 bytes a word however long windows are.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items if item is not None})
        number = {name: k for k, name in enumerate(self.names)}
        flat: list[int] = []
        windows: dict[int, list[tuple[int, int]]] = {}  # by length: place, number of the item
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            if ids:
                length = min(width, len(ids))
                windows.setdefault(length, []).extend((len(flat) + i, number.get(item, -1)) for i in range(len(ids) - length + 1))
                flat.extend(ids)
        self.ids = np.array(flat, dtype=np.uint64)
        self.by_length: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted(windows):
            places, owners = np.array(windows[length], dtype=np.int64).T
            exact = self.ids[places[:, None] + np.arange(length)]
            unique, which = np.unique(exact, axis=0, return_inverse=True)
            seed = 0x9E3779B97F4A7C15
            while True:  # another multiplier in the rare case that two windows share a hash
                hashes = rolling(unique.reshape(-1), length, seed)[::length]
                if len(np.unique(hashes)) == len(unique):
                    break
                seed += 2
            order = np.argsort(hashes)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            where = rank[which.reshape(-1)]
            one = np.empty(len(order), dtype=np.int64)
            one[where] = places
            both = np.unique(np.stack([where, owners])[:, owners >= 0], axis=1)
            self.by_length[length] = (seed, hashes[order], one, np.searchsorted(both[0], np.arange(len(order) + 1)), both[1])


def rolling(ids: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` ids."""
    n = len(ids) - length + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(length if n > 0 else 0):
        out = out * np.uint64(seed) + ids[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def scan(texts: list[bytes | None], index: WindowIndex) -> list[tuple[int, list[list[int]], set[str]]]:
    """For each text: its number of words, the hit ranges of words (merged, end exclusive) and the items that occur."""
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        words.extend(words_of(text or b""))
        words.append(b"")  # no window runs into the next document
    starts.append(len(words))
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words))
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    edges = np.array(starts)
    ranges: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for length, (seed, hashes, places, first, owners) in index.by_length.items():
        got = rolling(ids, length, seed)
        whole = np.flatnonzero(unknown[length:] == unknown[: len(got)]) if len(got) else np.zeros(0, dtype=np.int64)
        at = np.searchsorted(hashes, got[whole])
        at[at == len(hashes)] = 0
        same = hashes[at] == got[whole]
        whole, at = whole[same], at[same]
        for j in range(length):  # a hash only proposes; the words decide
            same = ids[whole + j] == index.ids[places[at] + j]
            whole, at = whole[same], at[same]
        for p, w, d in zip(whole.tolist(), at.tolist(), (np.searchsorted(edges, whole, side="right") - 1).tolist(), strict=True):
            own = ranges[d]
            p -= starts[d]
            if own and own[-1][0] <= p <= own[-1][1]:
                own[-1][1] = max(own[-1][1], p + length)
            else:
                own.append([p, p + length])
            items[d].update(owners[first[w] : first[w + 1]].tolist())
    return [(starts[d + 1] - starts[d] - 1, merge(ranges[d]), {index.names[k] for k in items[d]}) for d in range(len(texts))]


def merge(ranges: list[list[int]]) -> list[list[int]]:
    """The union of ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


HITS = "n_words long, hit_ranges array<struct<start: long, end: long>>, item_ids array<string>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


#: Buckets that items are dealt to for each part; successive buckets are filled into a part.
BUCKETS_A_PART = 32


class Benchmark:
    """The distinct items of a benchmark, dealt into parts; of a part only its own items reach the driver, when it is opened."""

    def __init__(self, benchmark: DataFrame, width: int, part_chars: int):
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
        self.width = width
        chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        self.buckets = 1 if chars <= part_chars else BUCKETS_A_PART * -(-chars // part_chars)
        self.items = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.buckets)))
        self.parts = [(0, 0)] if self.buckets == 1 else self._filled(part_chars)

    def _filled(self, part_chars: int) -> list[tuple[int, int]]:
        """The first and last bucket of each part: a new part begins where the next bucket would not fit."""
        parts, size = [], 0
        for r in self.items.groupBy("bucket").agg(F.sum(F.length("text")).alias("chars")).orderBy("bucket").toLocalIterator():
            if not parts or size + r["chars"] > part_chars:
                parts.append((r["bucket"], r["bucket"]))
                size = 0
            parts[-1] = (parts[-1][0], r["bucket"])
            size += r["chars"]
        return parts

    def opened(self, part: tuple[int, int]) -> WindowIndex:
        rows = self.items.where(F.col("bucket").between(*part)).select("item_id", "text").collect()
        return WindowIndex([(r["item_id"], r["text"]) for r in rows], self.width)


def _digest() -> Column:
    return F.sha2(F.col("text"), 256)


def _earlier(docs: DataFrame, bench: Benchmark) -> DataFrame | None:
    """(digest, ranges, items) of the distinct texts with hits in any part but the last; None where there is one part.

    Each part is a job of its own, whose written hits are all that is left of it when the next one opens. Equal texts have
    equal hits, so one row of them stays.
    """
    found = None
    for part in bench.parts[:-1]:
        shared = docs.sparkSession.sparkContext.broadcast(bench.opened(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hits = [(d, ranges, sorted(items)) for d, (_, ranges, items) in enumerate(scan(batch.column(0).cast(pa.binary()).to_pylist(), shared.value)) if ranges]
                places = pa.array([d for d, _, _ in hits], pa.int64())
                told = [[{"start": a, "end": b} for a, b in ranges] for _, ranges, _ in hits]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(places), pa.array(told, _RANGES), pa.array([items for _, _, items in hits], pa.list_(pa.string()))], names=["digest", "ranges", "items"])

        hits = docs.where("text is not null").select("text", _digest().alias("digest")).mapInArrow(run, "digest string, ranges array<struct<start: long, end: long>>, items array<string>")
        hits = materialise(hits.dropDuplicates(["digest"]), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found and found.groupBy("digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_chars: int = PART_CHARS) -> DataFrame:
    """docs (doc_id, text) with n_words, hit_ranges (of words, merged) and item_ids (distinct, sorted as strings)."""
    bench = Benchmark(benchmark, width, part_chars)
    kind = docs.schema["doc_id"].dataType.simpleString()
    earlier = _earlier(docs, bench)
    if earlier is None:
        rows = docs.select("doc_id", "text", F.lit(None).cast("array<struct<start: long, end: long>>").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    else:
        rows = docs.select("doc_id", "text", _digest().alias("digest")).join(earlier, "digest", "left").select("doc_id", "text", "ranges", "items")
    shared = docs.sparkSession.sparkContext.broadcast(bench.opened(bench.parts[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan(batch.column(1).cast(pa.binary()).to_pylist(), shared.value)
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ranges, items = [], []
            for (_, more, own), (told, named) in zip(found, before, strict=True):
                ranges.append([{"start": a, "end": b} for a, b in merge([*([x["start"], x["end"]] for x in told or ()), *more])])
                items.append(sorted({*(named or ()), *own}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _, _ in found], pa.int64()), pa.array(ranges, _RANGES), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hit_ranges", "item_ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, {HITS}")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return find_hits(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs: one stage without a shuffle for one part."""
    bench = Benchmark(benchmark, width, part_chars)
    place = docs.columns.index("text")
    earlier = _earlier(docs, bench)
    clean = docs if earlier is None else docs.join(earlier.select(F.col("digest").alias("_hit")), _digest() == F.col("_hit"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(bench.opened(bench.parts[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan(batch.column(place).cast(pa.binary()).to_pylist(), shared.value)
            yield batch.filter(pa.array([not r for _, r, _ in found], pa.bool_()))

    return clean.mapInArrow(run, docs.schema)


def remove_spans(text: str | None, hit_ranges: list[tuple[int, int]]) -> str | None:
    """The text without the characters from the first to the last word of each hit range."""
    if not text or not hit_ranges:
        return text
    raw = text.encode()
    clean = raw.translate(_TABLE)
    bounds, at = [], 0
    for word in clean.split():
        at = clean.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for a, b in hit_ranges:
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()
