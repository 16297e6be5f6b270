"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

1. language_id drops documents without a known language (null texts and texts without letters).
2. near_duplicates keeps, of each group of documents linked by five-word shingles at a likeness of 0.8 or more, the one
   with the least doc_id, and everything that links with nothing.
3. decontamination drops documents in which a window of ten words of a benchmark item occurs.
4. personal_data replaces personal data in the texts by its kind in brackets; n_chars follows.
5. packing cuts the texts' token ids into pieces and packs them into sequences of 2048.

All but the last return the columns of documents. Empty inputs give empty outputs; null ids and repeated rows are handled
as the operators' docstrings say. Very long texts go through whole, a text to a Python call and a piece of 2,048 tokens to a
row; of equal texts the least doc_id stays. Columns of documents may have the names of the operators' own: they pass through
the first four stages as they came, but for text and n_chars; packing returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, langid, ngram_join, packing, pii
from lexloom.llm.common import materialise, read_table

WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, WORDS, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: Suffix automata, connected components and a tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
