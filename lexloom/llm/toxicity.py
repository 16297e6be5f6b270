"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, drops invisible characters, maps homoglyphs and accented letters to plain ones, and reads digits and
signs inside words as the letters they stand for. Signs at a word's end are read both ways, as letters and as they are, in
fitting as in scoring, unless another digit follows them. The lexicon is learned from labelled rows outside the held-out fold
(crc32(doc_id) modulo 5 is 0): a bounded sample of at most `sample` rows of each label, those with the lowest hash of
doc_id. A term's evidence is the number of different contexts (the words before and after it) in which it stands in
texts of each label, so copies of one passage count once. Beginnings of words (STEMS letters) are terms too, which gathers
inflected forms; of terms that begin at one place the heaviest counts. A phrase of a term and its next or previous word that stands in
several clean contexts and in no toxic one is an exception: the term is not counted there. The model's size has a bound,
the heaviest `most_terms` terms and as many exceptions, far above what the sample gives. Two numbers of each text, the
sum of weights and that sum divided by the logarithm of the length, go through a logistic fitted on the same sample.

Defined cases: null and empty texts have no matches and get the score of a text without matches; a null label counts
nowhere; without labels of both classes every score is the share of label 1 (0 without labels); repeated rows are each
scored; of terms of equal weight that begin at one place the longest-read one counts once, and a score of exactly 0.5 is
predicted 1; an empty table gives no rows; very long texts are read whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialise, slices

SAMPLE = 3000
CONTEXTS, LEAST_WEIGHT, TERMS = 6, 2.0, 50_000
REMEMBERED = 1_000_000
STEMS = (5, 6, 7)

#: Letters of other scripts that look like Latin ones, and signs read as letters inside words.
HOMOGLYPHS = dict(zip("абвгеёзіїјкмнорсԁѕтухԛԝαβγειικνορτυχωɑɡⅼ", "a6breeзiijkmhopcdstyxqwaβyeiikvoptuxwagl", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)


def _folds() -> dict[int, str | None]:
    """Plain letters for accented, full-width and look-alike ones."""
    out: dict[int, str | None] = dict.fromkeys(INVISIBLE)
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        if plain != chr(c):
            out[c] = plain
    out |= dict.fromkeys(range(0x300, 0x370))
    return out | {ord(k): v for k, v in HOMOGLYPHS.items()}


_FOLDS = _folds()
_SIGNS = re.compile(r"[013457@$!](?=[013457@$!]*[a-z])")
#: The same after a word's last letter, with and without marks that may end a sentence.
_ENDS = [re.compile(r"(?<=[a-z])[013457@$!]*[013457@$](?=!*+(?![^\W_]|[@$]))"), re.compile(r"(?<=[a-z])[013457@$!]++(?![^\W_])")]
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLDS)
    return _SIGNS.sub(lambda m: LEET[m[0]], text)


def readings(text: str) -> list[str]:
    """The folded text, then with the signs at words' ends as letters, where that differs; all of one length."""
    plain = fold(text)
    return list(dict.fromkeys([plain, *(ends.sub(lambda m: "".join(LEET[c] for c in m[0]), plain) for ends in _ENDS)]))


class Lexicon:
    """Weights of terms (`stem*` for the beginning of a word) and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}  # the weight as a whole word, the weight as a stem, whether it is an exception
        for term, weight in weights.items():
            entries.setdefault(term.rstrip("*"), [None, None, False])[term.endswith("*")] = weight
        for phrase in exceptions:
            entries.setdefault(phrase, [None, None, False])[2] = True
        for key, entry in entries.items():
            self.automaton.add_word(key, (len(key), *entry))
        if entries:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """The heaviest term at each place outside exception phrases in a folded text: start, end, weight."""
        if not len(self.automaton):
            return []
        found: dict[int, tuple[int, float]] = {}
        excepted = []
        for last, (n, whole, stem, exception) in self.automaton.iter(text):
            a, b = last + 1 - n, last + 1
            if a and text[a - 1].isalnum():
                continue
            ends = b == len(text) or not text[b].isalnum()
            if exception and ends:
                excepted.append((a, b))
            weight = max((w for w in (whole if ends else None, stem) if w is not None), default=None)
            if weight is not None and weight > found.get(a, (0, 0.0))[1]:
                found[a] = (b, weight)
        return [(a, b, w) for a, (b, w) in sorted(found.items()) if not any(x <= a and b <= y for x, y in excepted)]

    def features(self, text: str | None) -> tuple[float, float]:
        found: dict[int, float] = {}
        for reading in readings(text or ""):
            for a, _, w in self.matches(reading):
                found[a] = max(w, found.get(a, 0.0))
        total = sum(found[a] for a in sorted(found))
        return total, total / np.log2(8 + len(text or "") / 6)


class Model:
    """A lexicon and the logistic over its features."""

    def __init__(self, lexicon: Lexicon, base: float):
        self.lexicon, self.base, self.beta = lexicon, base, None

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton's steps."""
        if len(set(y.tolist())) < 2:
            return
        z = np.concatenate([np.ones((len(x), 1)), self._scaled(x)], axis=1)
        beta = np.zeros(z.shape[1])
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            beta += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        self.beta = beta

    @staticmethod
    def _scaled(x: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(x[:, 0], 12) / 6, x[:, 1]], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(-1, 2)
        if self.beta is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + self._scaled(x) @ self.beta[1:], -30, 30)))


def _terms(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _placed(texts: list[str | None]) -> Iterator[tuple[int, str, str, str]]:
    """(number of the text, word before, word, word after) of each word that may be a term, in each reading."""
    for d, text in enumerate(texts):
        for reading in readings(text or ""):
            words = ["", *_WORD.findall(reading), ""]
            for i in range(1, len(words) - 1):
                if 2 < len(words[i]) < 40:
                    yield d, words[i - 1], words[i], words[i + 1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, context, toxic) as hashes, once for each context of a term in a task."""
    known: dict[str, list[int]] = {}
    told: set[tuple[str, int, int]] = set()
    for batch in slices(batches):
        toxic = batch.column(1).to_pylist()
        term, context, label = [], [], []
        for d, before, word, after in _placed(batch.column(0).to_pylist()):
            where = _hash(f"{before} {after}")
            if (word, where, toxic[d]) in told:
                continue
            told.add((word, where, toxic[d]))
            if word not in known:
                known[word] = [_hash(t) for t in _terms(word)]
            term += known[word]
            context += [where] * len(known[word])
            label += [toxic[d]] * len(known[word])
        if len(told) > REMEMBERED:
            told.clear()
            known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(context, pa.int64()), pa.array(label, pa.int32())], names=["term", "context", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_terms: int = TERMS) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic): at most most_terms terms, and as many exceptions."""
    spark = docs.sparkSession
    rows = labels.where("toxic in (0, 1)").where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(Lexicon({}), base)
    picked = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).distinct()
    texts = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(32), "toxic")  # at most 2 * sample ids
    seen = texts.mapInArrow(_contexts, "term long, context long, toxic int").distinct()
    share = {c: min(sample, counts[c]) for c in counts}
    weight = F.log((F.col("t") + 0.5) / share[1]) - F.log((F.col("c") + 0.5) / share[0])
    by_term = seen.groupBy("term").agg(F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    heavy = {r["term"]: r["w"] for r in by_term.where(F.col("t") >= CONTEXTS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc("w"), "term").limit(most_terms).collect()}
    learned = spark.sparkContext.broadcast(heavy)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The learned terms in words, and the phrases of a term and its neighbour with their contexts."""
        known: dict[str, list[str]] = {}
        for batch in slices(batches):
            toxic = batch.column(1).to_pylist()
            out: dict[tuple, None] = {}
            for d, before, word, after in _placed(batch.column(0).to_pylist()):
                if word not in known:
                    known[word] = [t for t in _terms(word) if _hash(t) in learned.value]
                for term in known[word]:
                    where = _hash(f"{before} {after}")
                    out[term, f"{before} {term}", where, toxic[d]] = out[term, f"{term} {after}", where, toxic[d]] = None
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], (pa.string(), pa.string(), pa.int64(), pa.int32())[k]) for k in range(4)], names=["term", "phrase", "context", "toxic"])

    told = materialise(texts.mapInArrow(phrases, "term string, phrase string, context long, toxic int").distinct(), "phrases")
    weights = {r["term"]: heavy[_hash(r["term"])] for r in told.select("term").distinct().collect()}  # at most most_terms
    by_phrase = told.groupBy("phrase").agg(F.max("toxic").alias("t"), F.countDistinct("context").alias("c")).where("t = 0 and c >= 3")
    exceptions = {r["phrase"] for r in by_phrase.orderBy(F.desc("c"), "phrase").limit(most_terms).collect()}
    lexicon = Lexicon(weights, exceptions)
    model = Model(lexicon, base)
    shared = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "a", "b"])

    got = sorted(texts.mapInArrow(features, "toxic int, a double, b double").collect())  # at most 2 * sample rows of numbers, in one order
    y = np.array([r["toxic"] for r in got])
    model.calibrate(np.array([(r["a"], r["b"]) for r in got]).reshape(-1, 2), y, np.where(y == 1, counts[1] / share[1], counts[0] / share[0]))
    return model


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
