"""Language ID by cross-parsing: each text is cut into the longest phrases known to a language's suffix automaton.

Fitting takes a bounded sample: TOTAL symbols, divided equally among all languages that have a labelled text with
letters, and at most `docs_per_lang` documents of each (those with the lowest hash of doc_id). A document gives
`chars_per_doc` symbols from PIECES places spread over its letters. No language is left out: beyond TOTAL / (docs_per_lang *
chars_per_doc) languages each has fewer documents, one at least. Labels are read only from rows whose crc32(doc_id) modulo
5 is not 0. Every letter of the sample is a symbol. A suffix automaton of the sample becomes one array in which the rows of
states, sparse as they are, lie between each other, so parsing is a table walk whatever the size of the alphabet.
Prediction reads whole texts: a text is cut into segments of `SEGMENT` symbols (phrases do not cross them), and all segments
of a batch walk side by side. The language with the fewest phrases, each weighed by the bits that point into its training
text, wins.

Defined cases: a null text, an empty one or one without letters is `und` with score 0; ties go to the language that sorts
first; without any labelled text everything is `und`; an empty table gives no rows; repeated rows are each judged; very
long texts are parsed whole, in some 20 bytes of memory a letter; other columns are kept or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begins, fold_of, materialise, slices

DOCS_PER_LANG, CHARS_PER_DOC = 160, 160
#: Symbols of all languages together, and places in a document they are taken from.
TOTAL, PIECES = 100 * DOCS_PER_LANG * CHARS_PER_DOC, 4
SEGMENT = 256
#: Symbols of the automata: 0 ends a segment, 1 is a gap between words, 2 a letter not seen in training; letters follow.
END, GAP, OTHER, FIRST = 0, 1, 2, 3
SHARPNESS = 120


def letter_table() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbol_table(texts: list[str]) -> np.ndarray:
    """For each code point its symbol: each letter of the training text has its own, in either case."""
    letters = {c for text in texts for c in text.lower() if c.isalpha()}
    table = np.where(letter_table(), OTHER, GAP).astype(np.int32)
    for k, letter in enumerate(sorted(letters)):
        table[ord(letter)] = FIRST + k
        if len(letter.upper()) == 1 and letter.upper() not in letters:
            table[ord(letter.upper())] = FIRST + k
    return table


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """The text's symbols; runs of anything but letters are one gap."""
    out = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = out == GAP
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return out[keep]


def suffix_automaton(pieces: list[np.ndarray]) -> list[dict[int, int]]:
    """The moves of each state of the suffix automaton of the pieces (state 0 is the root)."""
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for piece in pieces:
        last = 0
        for c in piece.tolist():
            if c in move[last]:  # a generalised automaton: the state may exist already
                q = move[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[last] + 1)
                link.append(link[q])
                p = last
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = clone
                last = clone
                continue
            now = len(move)
            move.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in move[p]:
                move[p][c] = now
                p = link[p]
            if p >= 0:
                q = move[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = len(move)
                    move.append(dict(move[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and move[p].get(c) == q:
                        move[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
    return move


def packed(move: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner[slot], to[slot] and fresh[symbol]: a state is a number, and its move by a symbol is at the sum of both if it owns that slot.

    The rows of states lie between each other. `to` and `fresh` are states times 4 plus phrases that end; fresh is the move
    of the root, where a symbol unknown to it is a phrase.
    """
    place = [0] * len(move)
    owner: dict[int, int] = dict.fromkeys(move[0], 0)
    bases = {0}
    low = free = 0
    for state in sorted(range(1, len(move)), key=lambda s: (-len(move[s]), s)):
        row = sorted(move[state])
        if len(row) > 1:  # the next place where the row fits
            base, tries = max(low, 1), 0
            while base in bases or any(base + c in owner for c in row):
                base += 1
                tries += 1
            if tries > 64:  # crowded
                low = base - 32
        elif row:  # the next free slot
            while free in owner or free <= row[0] or free - row[0] in bases:
                free += 1
            base = free - row[0]
        else:
            while low in bases:
                low += 1
            base = low
        bases.add(base)
        place[state] = base
        owner |= dict.fromkeys((base + c for c in row), base)
    size = max(bases) + symbols
    owners, to = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for slot, base in owner.items():
        owners[slot] = base
    fresh = np.full(symbols, 1, dtype=np.int64)
    fresh[END] = 0
    for state, moves in enumerate(move):
        for c, after in moves.items():
            to[place[state] + c] = place[after] * 4
    for c, after in move[0].items():
        fresh[c] = place[after] * 4
    return owners, to, fresh


class Model:
    """The automata of all languages and the table from code points to symbols."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.table = symbol_table([t for own in texts.values() for t in own])
        pieces = {k: [symbols_of(t, self.table) for t in texts[k]] for k in self.langs}
        self.bits = np.array([np.log2(2 + sum(map(len, pieces[k]))) for k in self.langs])
        self.automata = [packed(suffix_automaton(pieces[k]), int(self.table.max()) + 1) for k in self.langs]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [symbols_of(t or "", self.table) for t in texts]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        letters = np.array([bool((c > GAP).any()) for c in codes], dtype=bool)
        if not self.langs or not letters.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        grid = np.zeros(int(segments.sum()) * SEGMENT, dtype=np.int32)
        for c, at in zip(codes, np.concatenate([[0], np.cumsum(segments)[:-1]]) * SEGMENT, strict=True):
            grid[at : at + len(c)] = c
        steps = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T).astype(np.int64)
        bits = np.empty((len(texts), len(self.langs)))
        for k, (owner_of, to, fresh) in enumerate(self.automata):
            state = np.zeros(steps.shape[1], dtype=np.int64)
            phrases = np.zeros(steps.shape[1], dtype=np.int64)
            for column in steps:
                slot = state + column
                got = np.where(owner_of[slot] == state, to[slot], fresh[column] + (state != 0))
                phrases += got & 3
                state = got >> 2
            phrases += state != 0
            bits[:, k] = np.bincount(owner, weights=phrases, minlength=len(texts)) * self.bits[k] / np.maximum(1, sizes)
        best = bits.argmin(axis=1)
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(sizes, SHARPNESS)[:, None])
        score = 1 / odds.sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0).tolist()


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> Model:
    """Learn from docs (doc_id, text, lang), without the held-out fold."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    rows = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0) & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = materialise(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang), "langs")
    langs = ids.where("n = 1").count()
    each = max(1, min(docs_per_lang, TOTAL // (chars_per_doc * max(1, langs))))
    chars = max(1, min(chars_per_doc, TOTAL // max(1, langs)))
    chosen = ids.where(F.col("n") <= each).select("doc_id", "lang", "h").distinct()
    letters = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    part = max(1, chars // PIECES)
    step = F.floor((F.length("text") - part) / max(1, PIECES - 1)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(part)))
    cut = F.when(F.length("text") <= chars, F.array("text")).when(F.lit(chars < PIECES), F.array(F.substring("text", 1, chars))).otherwise(spread)
    sample = docs.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "h", "doc_id", letters.alias("text")).select("lang", "h", "doc_id", cut.alias("pieces"))
    sample = sample.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "pieces"))).where(F.col("n") <= each)
    texts: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "doc_id", "pieces").select("lang", "pieces").collect():  # at most TOTAL symbols, or one of each language
        texts.setdefault(r["lang"], []).extend(r["pieces"])
    return Model(texts)


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """lang_pred and score of a text. Texts alone go to Python, and what comes back is small: rows stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def told(texts: pa.Array) -> pa.Array:
        begins("langid")
        lang, score = [], []
        for piece in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], size=1_000_000):
            some = shared.value.predict(piece.column(0).to_pylist())
            lang += some[0]
            score += some[1]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return told(text)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    got = docs.select("doc_id", predicted(docs.sparkSession, fit(docs), F.col("text")).alias("p__"))
    return got.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "p__.lang_pred", "p__.score")


def keep_known(docs: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """The documents, with their own columns, whose predicted language is known (or one of langs)."""
    lang = predicted(docs.sparkSession, fit(docs), F.col("text"))["lang_pred"]
    return docs.where(lang.isin(langs) if langs else lang != "und")
