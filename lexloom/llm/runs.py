"""Periodic runs of words, by Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that cannot grow. In each stretch of a text
that can hold one:

1. a suffix automaton gives the Lempel-Ziv factors: each the longest string that also starts earlier, or one new word;
2. Main's algorithm finds, at each border between factors, the runs that touch it: longest common extensions to both
   sides for every period, from prefix functions of the words around the border;
3. a run strictly inside a factor is a copy of one inside the factor's earlier occurrence and is taken from there.

Why step 2 is whole: let a run [s, e) with period q touch a border, or not lie strictly inside a factor. If the border a
after word s + q - 1 is not behind e, the factor from a reaches e at least, and s > a0 - q where a0 is the border before
a; otherwise the run lies in front of a and touches a0, with the same bound. In both cases e is at most the end of the
factor at the border, 3 q is less than the two factors together, and so the words from a0 - q to that end show it whole.

Why only some stretches: after its first q words, every three words of a run occurred q places earlier. So words are
first narrowed down to stretches of m places whose three words occurred at most (m + 2) / 3 places earlier, again and
again until nothing changes; what lies (m + 2) / 3 words before such a stretch up to its end holds every run. This is
exact: other places cannot be in a run's repeating part.

Defined cases: null and empty texts have no words and no runs; ids choose which documents are made periodic, a null id
chooses none; repeated rows have a result each; a very long text is read whole by one task, in some 300 bytes a word of
its longest repeating stretch; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A run has so many words and periods at least.
LEAST, POWER = 6, 4

Run = tuple[int, int, int]  # first word, word behind the last, period


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each factor; occurrences may overlap.

    The automaton's states are rows of arrays; a state's first way out stands there too, further ones in a dictionary.
    """
    length, link, first, letter, target = array("q", [0]), array("q", [-1]), array("q", [-1]), array("q", [-1]), array("q", [0])
    more: dict[int, dict[int, int]] = {}

    def way(state: int, word: int) -> int:
        if letter[state] == word:
            return target[state]
        return more[state].get(word, -1) if state in more else -1

    def lead(state: int, word: int, to: int) -> None:
        if letter[state] in (-1, word):
            letter[state], target[state] = word, to
        else:
            more.setdefault(state, {})[word] = to

    last = 0
    for at, word in enumerate(words):
        new = len(length)
        for column, value in ((length, length[last] + 1), (link, 0), (first, at), (letter, -1), (target, 0)):
            column.append(value)
        p = last
        while p >= 0 and (q := way(p, word)) < 0:
            lead(p, word, new)
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                for column, value in ((length, length[p] + 1), (link, link[q]), (first, first[q]), (letter, letter[q]), (target, target[q])):
                    column.append(value)
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0 and way(p, word) == q:
                    lead(p, word, clone)
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, at = [], 0
    while at < len(words):
        state, end, before = 0, at, -1
        while end < len(words) and first[to := way(state, words[end])] < end:
            state, end = to, end + 1
            before = first[state] - (end - at) + 1
        end = max(end, at + 1)
        out.append((at, end, before))
        at = end
    return out


def prefixes(words: list[int]) -> list[int]:
    """At each place the length of the longest prefix of words that starts there."""
    n, left, right = len(words), 0, 0
    out = [n] + [0] * (n - 1) if n else []
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def touching(words: list[int], low: int, border: int, high: int) -> Iterator[Run]:
    """Runs of words that touch a border and show whole in words[low:high]; a run comes with its smallest period first."""
    v, u = words[low:border], words[border:high]
    most, m, k = (high - low) // POWER, len(v), len(u)
    back = v[::-1]
    ahead, behind = prefixes([*u, -1, *v, *u]), prefixes([*back, -1, *u[::-1], *back])
    for q in range(1, most + 1):
        both = []
        if q <= k:  # at least a period behind the border
            both.append((border - behind[m + 1 + k - q], border + q + (ahead[q] if q < k else 0)))
        if q <= m:  # or before it
            both.append((border - q - (behind[q] if q < m else 0), border + ahead[k + 1 + m - q]))
        for start, end in both:
            if end - start >= max(LEAST, POWER * q) and maximal(words, start, end, q):
                yield start, end, q


def maximal(words: list[int], start: int, end: int, period: int) -> bool:
    """Neither neighbour of words[start:end] extends it."""
    return not (start and words[start - 1] == words[start - 1 + period]) and not (end < len(words) and words[end] == words[end - period])


def runs_of(words: list[int]) -> list[Run]:
    """All runs of a sequence, by start."""
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in found:
            found[start, end] = period
            starting.setdefault(start, []).append((end, period))

    parts = factors(words)
    for i, (at, end, before) in enumerate(parts):
        if i:
            last = parts[i - 1][0]
            low = max(0, last - (end - last) // (POWER - 1))
            if end - low >= LEAST:
                for run in touching(words, low, at, end):
                    add(*run)
        if before >= 0 and starting:
            shift = at - before
            for start in range(at + 1, end - LEAST):
                for far, period in starting.get(start - shift, ()):
                    if far + shift < end:
                        add(start, far + shift, period)
    if parts:
        last, n = parts[-1][0], len(words)
        for run in touching(words, max(0, last - (n - last) // (POWER - 1)), n, n):
            add(*run)
    return sorted((start, end, period) for (start, end), period in found.items())


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) places between which every run lies with both its neighbours; none overlaps the next."""
    n = len(codes)
    if n < LEAST:
        return []
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # equal threes have equal sums; others that meet cost time only
    threes = mixed[:-2] + (mixed[1:-1] ^ (mixed[1:-1] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + (mixed[2:] ^ (mixed[2:] >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(threes, kind="stable")
    again = threes[order[1:]] == threes[order[:-1]]
    gap = np.zeros(n - 2, dtype=np.int64)  # 0: these three are new
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    keep = gap > 0
    while True:
        edges = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
        first, behind = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size = behind - first
        reach = np.where(size < LEAST - 3, 0, (size + 2) // (POWER - 1))
        narrow = keep.copy()
        narrow[keep] = gap[keep] <= np.repeat(reach, size)
        if (narrow == keep).all():
            break
        keep = narrow
    out: list[tuple[int, int]] = []
    for low, high in zip(np.maximum(first - reach - 1, 0).tolist(), np.minimum(behind + 3, n).tolist(), strict=True):
        while out and low < out[-1][1]:  # a longer stretch reaches further back, over several perhaps
            before, after = out.pop()
            low, high = min(low, before), max(high, after)
        out.append((low, high))
    return out


def find(words: list[bytes]) -> list[Run]:
    """All runs of a text's words, by start."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    out = []
    for low, high in stretches(codes):
        whole = codes[max(0, low - 1) : high + 1]  # what a stretch cuts off is a run of another one, or none
        for start, end, period in runs_of(codes[low:high].tolist()):
            at = low - max(0, low - 1)
            if maximal(whole, start + at, end + at, period):
                out.append((low + start, low + end, period))
    return sorted(out)


Edit = Callable[[int | None, list[bytes]], list[bytes]]

SPAN = "struct<start: long, length: long, period: long>"


def annotate(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, runs (by start) and collapsed: the words joined by one space without those that a run repeats.

    edit may change a document's words first.
    """
    rows = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, kept = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # at spaces, tabs, line ends and feeds
                words = edit(doc_id, words) if edit else words
                runs = find(words)
                if runs:
                    stay = np.ones(len(words), dtype=bool)
                    for start, end, period in runs:
                        stay[start + period : end] = False
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                spans.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<{SPAN}>, collapsed string")


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the documents that the query chooses by id, repeated from a place on; other words as they are."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def report(docs: DataFrame) -> DataFrame:
    """Per row the number of runs, the longest one and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    every = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return annotate(docs, made_periodic).withColumn("longest__", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest__.start")).alias("start"),
        F.col("longest__.length").alias("length"),
        (-F.col("longest__.period")).alias("period"),
        F.expr("1000 * longest__.length div -longest__.period").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
