"""A stored index of terms: blocks of postings in files by term, batches that supersede earlier ones, and the best hits of a query.

A block holds the postings of one term in some BLOCK chunks, and the greatest count and the greatest sum of weights of one
of them. Blocks of all terms cut the chunks alike, so what a query can reach in a block is known from a few numbers. Files
are laid out by buckets of terms; a query opens the buckets of its own terms and no others, first the numbers alone (a
column each), then the postings of the blocks that can reach the page: those with the highest bounds, then those whose
bound is not below the last hit so far.

Texts are dealt to the writers by their blocks, so no word is shuffled: a writer has all words of some WRITER blocks, and
a query's blocks of one number are ranked together, in arrays. A block may come in several pieces, since a writer holds one
Arrow batch of chunks at once; rows of one chunk are never in two pieces.

A batch names the documents it holds. Chunks of documents that a later batch holds are not found any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexemes
from ..sources import snapshots
from . import search as q

#: Chunks a block has on average, blocks that one writer has at most, blocks that a query opens at first.
BLOCK, WRITER, FIRST = 2048, 64, 64
BUCKETS = 16
#: A place for each use of the term; the text's first word has place 0, a heading's words have those before it.
_BLOCK_ROW = "term string, block int, most long, heaviest double, chunks array<long>, docs array<long>, places array<int>"
_HITS = "batch int, chunk_id long, doc_id long, raw_rank double"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are, nulls among them."""
    return values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _weights(places: np.ndarray) -> np.ndarray:
    return np.where(places < 0, lexemes.WEIGHTS["A"], lexemes.WEIGHTS["B"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted chunks batch by batch; the rows of a batch's last chunk go with the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if table.num_rows:
            cut = int(np.flatnonzero(_changes(*(_codes(_column(table, k)) for k in ("block", "chunk_id", "doc_id"))))[-1])
            yield table.slice(0, cut)
            table = table.slice(cut)
        rest = table
    if rest is not None:
        yield rest


def _posted(chunks: pa.Table, english: bool) -> pa.RecordBatch | None:
    """The rows of a piece of chunks (block, chunk_id, doc_id, ahead__, words__): all uses of a term in a block are one."""
    words = _column(chunks, "words__")
    sizes, ahead = pc.list_value_length(words).to_numpy(), _column(chunks, "ahead__").to_numpy()
    said = words.flatten().dictionary_encode()
    terms, code = said.dictionary, said.indices.to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes + ahead, sizes)
    if english:
        stems = pa.array([None if w in lexemes.STOP else lexemes.stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, code = stems.dictionary, stems.indices.fill_null(-1).to_numpy()[code]
        searched = code >= 0
        row, place, code = row[searched], place[searched], code[searched]
    if not len(row):
        return None
    block = _column(chunks, "block").to_numpy()[row].astype(np.int64)
    order = np.argsort(block * len(terms) + code, kind="stable")
    block, code, row, place = block[order], code[order], row[order], place[order]
    chunk = np.cumsum(_changes(*(_codes(_column(chunks, k)) for k in ("chunk_id", "doc_id"))))[row]
    begins = _changes(block, code)
    own = begins | _changes(chunk)
    starts, posting = np.flatnonzero(begins), np.flatnonzero(own)
    inside = np.searchsorted(posting, starts)
    number = np.cumsum(own) - 1
    most = np.maximum.reduceat(np.bincount(number), inside)
    heaviest = np.maximum.reduceat(np.bincount(number, _weights(place)), inside)
    ends = pa.array(np.append(starts, len(row)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (_column(chunks, "chunk_id").take(pa.array(row)), _column(chunks, "doc_id").take(pa.array(row)), pa.array(place, pa.int32()))]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code[starts])), pa.array(block[starts], pa.int32()), pa.array(most, pa.int64()), pa.array(heaviest), *lists], ["term", "block", "most", "heaviest", "chunks", "docs", "places"])


def add(spark: SparkSession, root: str, chunks: DataFrame, english: bool = True) -> snapshots.Batch:
    """Store the postings of chunks (chunk_id, doc_id, text and perhaps heading; ids are whole numbers) as the next batch."""
    blocks = max(1, -(-chunks.count() // BLOCK))
    writers = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4)), -(-blocks // WRITER))
    ids = [F.col(k).cast("long").alias(k) for k in ("chunk_id", "doc_id")]
    keyed = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), *ids, "text", *(["heading"] if "heading" in chunks.columns else []))
    dealt = keyed.repartitionById(writers, F.col("block") % writers).sortWithinPartitions("block", "chunk_id", "doc_id")

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (rows for piece in _pieces(batches) if (rows := _posted(piece, english)) is not None)

    whole = q.worded(dealt, ["block", "chunk_id", "doc_id"]).mapInArrow(posted, _BLOCK_ROW).withColumn("bucket", _bucket(F.col("term")))

    def write(name: str, df: DataFrame, path: str) -> None:
        if name == "postings":
            df.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        else:
            df.write.parquet(path)

    held = chunks.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return snapshots.publish(spark, root, {"postings": whole, "documents": held}, {"blocks": blocks, "english": english}, write)


def _ranked(batch: pa.Scalar, table: pa.Table, query: lexemes.Query) -> pa.Table:
    """(batch, chunk_id, doc_id, raw_rank) of the chunks of one block that fit a query, from the rows of its terms."""
    sizes, spoken = pc.list_value_length(_column(table, "places")).to_numpy(), _column(table, "term").dictionary_encode()
    chunks, docs = _column(table, "chunks").flatten(), _column(table, "docs").flatten()
    term, place, ids = np.repeat(spoken.indices.to_numpy(), sizes), _column(table, "places").flatten().to_numpy().astype(np.int64), (_codes(chunks), _codes(docs))
    order = np.lexsort((place, term, *ids))
    begins = _changes(ids[0][order], ids[1][order])
    own, term, place, firsts = np.cumsum(begins) - 1, term[order], place[order], order[begins]
    least = place.min(initial=0)
    span = int(place.max(initial=0) - least) + 1 + max(shift for items in query for item in items for _, shift in item.terms)  # no phrase reaches into the next chunk
    keys = {name: np.unique((own * span + place - least)[term == k]) for k, name in enumerate(spoken.dictionary.to_pylist())}
    nothing, n = np.empty(0, np.int64), len(firsts)
    ranks = np.full(n, -1.0)
    for items in query:
        fits = np.ones(n, bool)
        for item in items:
            (first, _), *rest = item.terms
            starts = keys.get(first, nothing)
            for t, shift in rest:
                starts = starts[np.isin(starts + shift, keys.get(t, nothing))]
            stands = np.zeros(n, bool)
            stands[starts // span] = True
            fits &= stands == item.wanted
        wanted = [item for item in items if item.wanted]
        terms = lexemes.terms_of([wanted])
        at = {t: keys.get(t, nothing) for t in terms}
        if len(terms) == 1:  # every place is a cover
            rank = np.bincount(at[terms[0]] // span, _weights(at[terms[0]] % span + least), n)
        else:
            rank = np.zeros(n)
            for k in np.flatnonzero(fits):
                here = {t: x[slice(*np.searchsorted(x, (k * span, (k + 1) * span)))] - k * span for t, x in at.items()}
                rank[k] = lexemes.cover_density([wanted], {t: x.tolist() for t, x in here.items()}, {t: _weights(x + least).tolist() for t, x in here.items()})
        ranks = np.where(fits, np.maximum(ranks, rank), ranks)
    fit = np.flatnonzero(ranks >= 0)
    which = pa.array(firsts[fit])
    return pa.table([pa.array([batch.as_py()] * len(fit), pa.int32()), chunks.take(which), docs.take(which), pa.array(ranks[fit])], ["batch", "chunk_id", "doc_id", "raw_rank"])


class Reader:
    """The index as it was when the reader was made: its files are listed once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.batches = spark, snapshots.batches(spark, root)
        self.english = bool(self.batches and self.batches[-1].notes["english"])
        self.postings = self.held = None
        for batch in self.batches:
            own = spark.read.schema(f"{_BLOCK_ROW}, bucket int").parquet(batch.tables["postings"]).withColumn("batch", F.lit(batch.number))
            self.postings = own if self.postings is None else self.postings.unionByName(own)
        for batch in self.batches[1:]:
            own = spark.read.schema("doc_id long").parquet(batch.tables["documents"]).withColumn("later", F.lit(batch.number))
            self.held = own if self.held is None else self.held.unionByName(own)

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms, from the files of their buckets alone."""
        place = F.col("bucket") == _bucket(F.lit(terms[0]))
        for term in terms[1:]:
            place |= F.col("bucket") == _bucket(F.lit(term))
        return self.postings.where(place & F.col("term").isin(terms))

    def bounds(self, blocks: DataFrame, query: str) -> DataFrame:
        """(batch, block, bound): what a chunk of a block can reach at most.

        Of one term the rank is the sum of its weights. Of several, every cover begins at a place of its own and counts 1 at
        most, so the places of all wanted terms bound it. A block without one of the wanted terms is left out.
        """
        alternatives = [sorted({t for item in items if item.wanted for t, _ in item.terms}) for items in lexemes.parsed(query, self.english)]
        value = lambda t, name: F.max(F.when(F.col("term") == t, F.col(name))).cast("double")  # noqa: E731  the greatest of all pieces
        each = [value(a[0], "heaviest") if len(a) == 1 else sum((value(t, "most") for t in a[1:]), value(a[0], "most")) for a in alternatives]
        bound = F.array_max(F.array_compact(F.array(*each)))  # an alternative that lacks a term is null
        return blocks.groupBy("batch", "block").agg(bound.alias("bound")).where("bound is not null")

    def hits(self, blocks: DataFrame, query: str) -> DataFrame:
        """(chunk_id, doc_id, raw_rank) of current chunks in blocks of postings."""
        wanted = lexemes.parsed(query, self.english)
        rows = blocks.select("batch", "block", "term", "chunks", "docs", "places")
        fit = rows.groupBy("batch", "block").applyInArrow(lambda key, table: _ranked(key[0], table, wanted), _HITS)
        if self.held is not None:
            fit = fit.join(self.held, (fit["doc_id"] == self.held["doc_id"]) & (fit["batch"] < self.held["later"]), "left_anti")
        return fit.drop("batch")

    def best(self, query: str, most: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The `most` best hits by (raw_rank descending, chunk_id) among those that `keep` leaves; at most `most` rows reach the driver."""
        order = [F.desc("raw_rank"), F.asc("chunk_id")]
        terms = lexemes.terms_of(lexemes.parsed(query, self.english))
        nothing = "chunk_id long, doc_id long, raw_rank double"
        if not self.batches or not terms:
            return self._kept(self.spark.createDataFrame([], nothing), keep)
        blocks = self.blocks(terms)
        if sum(batch.notes["blocks"] for batch in self.batches) <= FIRST:
            return self._kept(self.hits(blocks, query), keep).orderBy(*order).limit(most)
        bounds = self.bounds(blocks, query)
        head = bounds.orderBy(F.desc("bound"), "batch", "block").limit(FIRST + 1).collect()
        chosen = self.spark.createDataFrame([(r["batch"], r["block"]) for r in head[:FIRST]], "batch long, block int")
        first = self._kept(self.hits(blocks.join(F.broadcast(chosen), ["batch", "block"], "left_semi"), query), keep).orderBy(*order).limit(most)
        if len(head) <= FIRST:
            return first
        known = first.collect()
        schema = first.schema
        least = known[-1]["raw_rank"] if len(known) == most else 0.0
        first = self.spark.createDataFrame(known, schema)
        open_ = bounds.where(F.col("bound") >= least * (1 - 1e-9)).join(F.broadcast(chosen), ["batch", "block"], "left_anti")
        rest = self._kept(self.hits(blocks.join(open_.select("batch", "block"), ["batch", "block"], "left_semi"), query), keep)
        return first.unionByName(rest).orderBy(*order).limit(most)

    @staticmethod
    def _kept(hits: DataFrame, keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        return keep(hits) if keep else hits


def search(reader: Reader, chunks: DataFrame, query: str, on: Column | None = None, limit: int = 20, offset: int = 0, user_state: str | None = None, synonyms: dict[str, list[str]] | None = None, **facets: object) -> tuple[DataFrame, DataFrame, list[str]]:
    """(items, groups, expanded terms) of a query over an index and its chunks' columns, as `search.search` gives them.

    The day is today in UTC unless one is given. Terms with synonyms bring these as alternatives. Chunks are narrowed before
    the best ones are chosen; these (CANDIDATES rows) come to the driver once, and the texts of the page alone are read for snippets.
    """
    on = F.current_date() if on is None else on
    asked, more = expanded(query, synonyms or {})
    facts = q.narrowed(chunks, on, **facets).drop("text", "heading", "doc_id")
    top = reader.best(asked, q.CANDIDATES, lambda hits: hits.join(facts, "chunk_id"))
    best = q.scored(reader.spark.createDataFrame(top.collect(), top.schema).coalesce(1), on, user_state)
    rows = sorted(best.collect(), key=lambda r: (-r["score"], r["doc_id"]))
    shown = rows[offset : offset + limit]
    texts = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in shown])).select("chunk_id", "text")
    items = texts.join(F.broadcast(reader.spark.createDataFrame(shown, best.schema)), "chunk_id")
    return q.snippets(items, asked, reader.english).orderBy(F.desc("score"), "doc_id"), q.group_counts(reader.spark.createDataFrame(rows, best.schema)), more


def expanded(query: str, synonyms: dict[str, list[str]]) -> tuple[str, list[str]]:
    """The query with the synonyms of terms in it as alternatives, and these."""
    found = [m for term, more in synonyms.items() if f" {term.lower()} " in f" {' '.join(lexemes.plain(query))} " for m in more]
    found = list(dict.fromkeys(found))
    return query + "".join(f' OR "{m}"' for m in found), found
