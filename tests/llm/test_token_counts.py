"""Token counts against the libraries, and what the cache stores."""

import random

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexloom.llm import token_counts
from lexloom.llm.tokens import vocabulary_path
from tests.llm.conftest import PROSE, SCHEMA, rows, texts_of

AWKWARD = ["H̱ello ẖello", "Ä Ä ä", "<|endoftext|> a <|ENDOFTEXT|>", "İstanbul ISTANBUL", "tab\tand nbsp em", "ÀÉÎ ǅ", "12 1 2", "'S 's DON'T", "\u0085next\u000bline", "ſ K Å"]


def counted(spark, df, cache, name):
    return token_counts.report(df, cache, vocabulary_path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, docs, tmp_path, name):
    rnd = random.Random(3)
    more = [(100 + k, "".join(rnd.choice([*AWKWARD, " ", "  ", "word", "WORD", "\n"]) for _ in range(4))) for k in range(60)]
    table = docs.unionByName(spark.createDataFrame(rows([*((50 + k, t) for k, t in enumerate(AWKWARD)), *more, (99, PROSE * 3000)]), SCHEMA))
    path = vocabulary_path(name)
    if name.endswith(".model"):
        library = SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted(str((i, len((t or "").encode()), n := count(t or ""), n > 2048)) for i, t in texts_of(table))
    for _ in range(2):  # the second time from the cache
        assert sorted(str(tuple(r)) for r in counted(spark, table, str(tmp_path), name).collect()) == want


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache, seen, real = str(tmp_path), [], token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda texts, path: real(seen.append(texts.count()) or texts, path))
    one = spark.createDataFrame([(1, "A b\tc"), (2, "a  B c "), (3, "other"), (4, None), (5, "")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b c"), (2, "new"), (2, "new")], "doc_id long, text string")
    assert token_counts.report(one, cache).count() == 5
    assert token_counts.report(two, cache).count() == 3
    assert token_counts.report(two, cache).count() == 3
    assert seen == [3, 1, 0]
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda path: "another")  # counts of another version are not read
    assert token_counts.report(two, cache).count() == 3
    assert seen[-1] == 2


def test_twice_stored_rows_count_once(spark, tmp_path):
    table = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "doc_id long, text string")
    want = sorted(map(tuple, token_counts.report(table, str(tmp_path)).collect()))
    version = token_counts.tokenizer_version(vocabulary_path())
    where = f"{tmp_path}/tokenizer={version}"
    spark.read.parquet(where).write.mode("append").parquet(where)  # as another run at the same time would
    assert sorted(map(tuple, token_counts.report(table, str(tmp_path)).collect())) == want


def test_empty_table(spark, nothing, tmp_path):
    assert token_counts.report(nothing, str(tmp_path)).count() == 0
