"""Token counts with a digest cache.

The cache is a Parquet folder with a sub-folder for each tokenizer version (a digest of the vocabulary file and of the
library's version) and in it rows (content, n_tokens), content being a digest of a normalised text. A run joins the
digests of its documents with the stored rows, encodes each distinct text that is missing once, appends those rows and
takes every document's count from the cache. Texts travel at most once for each distinct content and task; a content that
a third of all rows share is summed up where it is read, and the last join moves digests only, so that Spark can split it.

Normalising may only join texts that have one count. Where the file's rules are those under which words can be coded one
by one (`tokens.Coder.by_words`), texts of plain characters without special strings lose their case (A-Z) and their runs of
white space; every other text, and every text under another file, is its own normal form.

Appends go through Spark's writer: an attempt that fails leaves no rows. Two runs at once may append a row twice; equal
rows count once when read. Rows hold for ever, since a new vocabulary or library is a new version.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows have a result each; null ids stay; a very
long text is encoded whole, by one task; an empty table gives no rows and appends nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache as once
from importlib.metadata import version as version_of

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_root, slices
from .tokens import coder, vocabulary_path

LIMIT = 2048
#: Texts of these characters alone, without the opening of a special string, are normalised (`tokens` says why they may be).
_PLAIN = "\\A[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f]*\\z"
_SPECIAL = "<|"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = "content binary, n_tokens long"


def library_of(path: str) -> str:
    """The library that reads a vocabulary file."""
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """A digest of the file and of the library that reads it."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read())
    name = library_of(path)
    digest.update(f"{name} {version_of(name)}".encode())
    return digest.hexdigest()


@once
def counter(path: str) -> Callable[[str], int]:
    """How many ids the library gives a text, without begin, end or added special ids."""
    if library_of(path) == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, add_bos=False, add_eos=False))
    encode = coder(path).encode
    return lambda text: len(encode(text)) // 4


def content_of(text: Column, by_words: bool) -> Column:
    """The digest of a text's normal form."""
    whole = F.coalesce(text, F.lit(""))
    if by_words:
        even = F.trim(F.translate(F.regexp_replace(whole, "[\\t\\n\\r ]+", " "), _UPPER, _LOWER))
        whole = F.when(whole.rlike(_PLAIN) & ~whole.contains(_SPECIAL), even).otherwise(whole)
    return F.unhex(F.sha2(whole.cast("binary"), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The stored rows of a version, each content once; None before its first append."""
    try:
        rows = spark.read.schema(ROW).parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches):
            numbers = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(numbers, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, ROW)


def fill(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """Append the counts of all contents of docs that the cache lacks; the stored rows after that."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    by_words = library_of(path) == "tokenizers" and coder(path).by_words
    texts = docs.select(content_of(F.col("text"), by_words).alias("content"), "text").groupBy("content").agg(F.first("text").alias("text"))
    known = stored(spark, cache, version)
    missing = texts if known is None else texts.join(known, "content", "left_anti")
    _encoded(missing, path).write.mode("append").option("compression", "zstd").parquet(f"{cache}/tokenizer={version}")
    return stored(spark, cache, version)


def report(docs: DataFrame, cache: str | None = None, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, by a cache that all runs of a corpus share.

    Without a cache the run has one of its own in the shared folder, which lives as long as the application.
    """
    path = vocabulary or vocabulary_path()
    cache = cache or f"{scratch_root(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    by_words = library_of(path) == "tokenizers" and coder(path).by_words
    counts = materialise(fill(docs.select("text"), cache, path), "counts")  # read plainly below, so that Spark can split a hot content
    keyed = docs.select("doc_id", content_of(F.col("text"), by_words).alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
