"""What an operator keeps in a Python worker goes when the worker gets a task of another one."""

from lexloom.llm import common, ngram_join, tokens


def test_words_go_with_the_next_operators_task():
    path = tokens.vocabulary_path()
    coder = tokens.coder(path)
    ids = coder.encode("Some words, some more")
    ngram_join.shingles(b"some other words")
    assert coder.words and ngram_join._words
    common.begins("ngram_join")
    assert not tokens._coders and ngram_join._words
    assert tokens.coder(path).encode("Some words, some more") == ids and not ngram_join._words
    assert tokens.coder(path) is tokens.coder(path)
