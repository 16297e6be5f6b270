"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of every whole text come from one scan. All labelled rows outside the held-out fold (crc32(doc_id) modulo 3
is 1) add to per-class counts, sums and products, which Spark sums; only those few numbers reach the driver. Each class
covariance is shrunk towards the pooled one and the pooled one towards its diagonal; the Cholesky factors are computed
once and sent with the model. The score is the logistic of the difference of the two log densities.

Defined cases: null and empty texts have all-zero statistics and are scored like any other; a label that is null counts
nowhere; without labels of both classes every score is the share of label 1 (0.5 without labels); repeated rows and
labels each count; documents of equal statistics have equal scores, and a score of exactly 0.5 is predicted 1; an empty
table gives no rows; very long texts are read whole, one at a time, by the same formulas as any other; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialise, slices

NAMES = ("chars", "word_length", "upper", "digit", "bang", "symbol", "space", "line", "distinct", "top", "pairs", "repeated_lines", "packed", "other", "end_marks", "long_words")
WITHIN, ACROSS = 0.1, 0.1


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a UTF-8 text, in the order of NAMES."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digit, wide = int(count[48:58].sum()), int(count[128:].sum())
    space = int(count[32] + count[9:14].sum())
    symbol = n - upper - lower - digit - wide - space
    words = text.lower().split()
    lines = text.split(b"\n")
    freq = Counter(words)
    m = max(1, len(words))
    top = max(freq.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = lambda k: float(np.log((k + 0.5) / (n - k + 0.5 + n * 1e-3)))
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / m)),
        float(np.log((upper + 1) / (upper + lower + wide + 20))),
        share(digit),
        share(int(count[33])),
        share(symbol),
        share(space),
        float(np.log1p(n / len(lines))),
        float(np.log1p(len(freq)) / np.log1p(m)),
        float(np.log(top / m + 0.01)),
        pairs / max(1, m - 1),
        float(np.log(1.01 - len(set(lines)) / len(lines))),
        len(zlib.compress(text, 1)) / (n + 40),
        share(wide),
        share(int(count[46] + count[44])),
        sum(len(w) > 18 for w in words) / m,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array of statistics."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Model:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    def __init__(self, sums: dict[int, np.ndarray]):
        """sums: for each class, the sum over its rows of the outer product of (1, x) with itself."""
        n = {c: s[0, 0] for c, s in sums.items() if s[0, 0] > 0}
        total = sum(n.values())
        self.base = n.get(1, 0) / total if total else 0.5
        self.parts = {}
        if len(n) == 2:
            mean = {c: sums[c][0, 1:] / n[c] for c in n}
            cov = {c: sums[c][1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in n}
            pooled = sum(cov[c] * n[c] for c in n) / total
            pooled = (1 - ACROSS) * pooled + ACROSS * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
            for c in n:
                weight = WITHIN + (1 - WITHIN) * 20 / (20 + n[c])  # few rows: lean on the pooled covariance
                factor = np.linalg.cholesky((1 - weight) * cov[c] + weight * pooled + 1e-9 * np.eye(len(pooled)))
                self.parts[c] = (mean[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n[c] / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.parts) < 2:
            return np.full(len(x), self.base)
        density = {c: base - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for c, (mean, inverse, base) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats (doc_id, x) and labels (doc_id, quality); the held-out fold is left out."""
    side = len(NAMES) + 1
    rows = stats.where(fold_of(F.col("doc_id"), 3) != 1).join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id").select("quality", "x")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, side * side))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, side - 1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for c in (0, 1):
                total[c] += (x[y == c].T @ x[y == c]).reshape(-1)
        places = np.tile(np.arange(side * side), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], side * side), pa.int32()), pa.array(places, pa.int32()), pa.array(total.reshape(-1))], names=["quality", "place", "value"])

    sums = {0: np.zeros(side * side), 1: np.zeros(side * side)}
    for r in rows.mapInArrow(partial, "quality int, place int, value double").groupBy("quality", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["quality"]][r["place"]] = r["value"]
    return Model({c: s.reshape(side, side) for c, s in sums.items()})


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = materialise(with_statistics(docs), "quality")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
