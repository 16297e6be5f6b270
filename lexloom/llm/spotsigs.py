"""Document fingerprints by SpotSigs: chains of content words after common words.

At each anchor (a common word) the next CHAIN content words form a signature; a document's fingerprint is the set of its
signatures, as 32-bit hashes. Where no common word stands within REACH words on either side, a word is an anchor itself, so
texts of languages without listed words, code and lists have chains too, and an edit changes only the chains near it.
Characters of scripts written without spaces are words of their own. A text with words but no signature (CHAIN content
words or fewer) has one for its whole word sequence. Fingerprints are compared by Jaccard likeness; two sets whose sizes
differ too much for a threshold are never opened.

`fingerprints` gives each document's own, `report` compares it with an edited text and with the next document, and
`near_pairs` joins a whole table: sets are partitioned by length, and within a partition and its neighbour only pairs
that share one of their first signatures are compared, each pair once.

Defined cases: null text counts as empty; a text without words has the empty fingerprint, which is like another empty one
(1) and like nothing else (0); repeated rows follow each other in the order of doc_id, rows of one doc_id in that of their
texts' hashes; null ids come first; other columns are ignored. The last document's next one is the first; a single document
is its own next one; an empty table gives no rows; very long texts are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_key
from .ordering import BUCKET, CARRIED, with_previous

CHAIN, REACH = 3, 4
#: The anchors, common words of four languages.
ANCHORS = frozenset(
    x.encode()
    for x in (
        "a an and are as at be by for from had has have in is it of on or she that the their there this to was were which with you "
        "le la les un une des du de et est en que qui dans pour par sur avec au ce il elle pas plus "
        "der die das und ist ein eine den dem des nicht mit von zu auf als sich auch es im "
        "el los las una uno del y o es en por para con no se lo su al"
    ).split()
)
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
#: UTF-8 characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Chinese signs and full-width forms.
_ALONE = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80-\x82]|[\x9e\x9f])[\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xbc-\xbf][\x80-\xbf]|\xf0[\x80-\xbf]{3}")


def signatures(text: bytes) -> np.ndarray:
    """The sorted distinct signatures of a UTF-8 text."""
    plain = text.translate(_TABLE)
    words = (plain if text.isascii() else _ALONE.sub(rb" \g<0> ", plain)).split()
    if not words:
        return np.zeros(0, dtype=np.uint32)
    code = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    anchor = np.fromiter(map(ANCHORS.__contains__, words), dtype=bool, count=len(words))
    content = code[~anchor]
    upto = np.concatenate([[0], np.cumsum(anchor)])  # common words before each place
    places = np.arange(len(words))
    opens = upto[np.minimum(places + REACH + 1, len(words))] == upto[np.maximum(places - REACH, 0)]  # none near: the word is an anchor itself
    opens |= anchor
    first = np.cumsum(~anchor)[opens]  # content words up to an anchor: the index of the next one
    where = code[opens][first + CHAIN <= len(content)]
    first = first[first + CHAIN <= len(content)]
    mix = where * np.uint64(0xC2B2AE3D27D4EB4F)  # sums of words are linear: two of them must not meet unmixed
    mix ^= mix >> np.uint64(29)
    for k in range(CHAIN):
        mix = (mix ^ content[first + k]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(31)
    if not len(mix):
        return np.array([crc32(b" ".join(words))], dtype=np.uint32)
    return np.unique((mix >> np.uint64(16)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two signature sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def as_text(sigs: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return sigs.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text whose last half is replaced by as many of the first characters of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sigs (binary: sorted 32-bit big-endian signatures) and n_sigs."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [signatures(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.astype(">u4").tobytes() for g in got], pa.binary()), pa.array([len(g) for g in got], pa.int32())], names=["doc_id", "sigs", "n_sigs"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sigs binary, n_sigs int")


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's, in descending order of doc_id."""
    spark = docs.sparkSession
    n = max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows, _ = with_previous(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 8 * n)
    order = [F.col(BUCKET), F.col(CARRIED).desc(), F.col("doc_id").asc_nulls_first(), text_key(F.col("text"))]
    placed = rows.repartition(n, BUCKET).sortWithinPartitions(*order).select("doc_id", "text", BUCKET, CARRIED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sigs_before = "", None
        for batch in slices(batches):
            out = []
            for doc_id, text, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sigs = signatures(text.encode())
                if not carried:
                    other = edited(text, before)
                    changed = signatures(other.encode())
                    out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), as_text(sigs), as_text(changed), likeness(sigs, changed), likeness(sigs, sigs_before)))
                before, sigs_before = text, sigs
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", *(x.split()[0] for x in OUT.split(", "))])

    return placed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of different fingerprints, and (a, b, 1.0) from a copy to its representative.

    Length partitions grow by 1 / threshold, so partners are in the same or the next one. A set's rarest signatures, as many
    as must meet a partner's, are its postings, so frequent ones bring few together; the size bound prunes before sets are opened.
    """
    prints = materialise(fingerprints(docs).where("n_sigs > 0 and doc_id is not null"), "spots")
    classes = prints.groupBy("sigs").agg(F.min("doc_id").alias("a"), F.first("n_sigs").alias("n"))
    copies = prints.join(classes, "sigs").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    part = F.floor(F.log(F.col("n").cast("double")) / -np.log(threshold)).cast("int")
    each = classes.withColumn("part", part).select("a", "n", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("sigs", i * 4 + 1, F.lit(4)))).alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("often", "sig"))
    posts = each.join(often, "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    one = posts.select("sig", "part", F.col("a").alias("x"), F.col("n").alias("nx"))
    two = posts.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("a").alias("y"), F.col("n").alias("ny"))
    met = one.join(two, ["sig", "part"]).where((F.col("ny") <= F.col("nx")) & (F.col("ny") >= F.col("nx") * threshold) & ((F.col("ny") < F.col("nx")) | (F.col("y") < F.col("x")))).select("x", "y").distinct()
    sets = classes.select("a", "sigs")
    opened = met.join(sets.select(F.col("a").alias("x"), F.col("sigs").alias("sx")), "x").join(sets.select(F.col("a").alias("y"), F.col("sigs").alias("sy")), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            like = [likeness(np.frombuffer(a, ">u4"), np.frombuffer(b, ">u4")) for a, b in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True)]
            keep = [k for k, v in enumerate(like) if v >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([f(x[k], y[k]) for k in keep], pa.int64()) for f in (min, max)] + [pa.array([like[k] for k in keep], pa.float64())], names=["a", "b", "likeness"])

    return opened.select("x", "y", "sx", "sy").mapInArrow(compare, "a long, b long, likeness double").unionByName(copies.select(F.col("a").cast("long"), F.col("b").cast("long"), "likeness"))
