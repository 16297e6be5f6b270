"""Ids of words that are coded one by one."""

from lexloom.llm import tokens


def test_words_of_letters_skip_the_pattern_and_all_words_have_the_librarys_ids():
    coder = tokens.Coder(tokens.vocabulary_path())
    texts = ["abc Abc's straße naïve ªº", "don't x1y2 -a- ''re 's'll", "~|<>_0189 ſ ƻ ǅ"]
    plain = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.letters_alone
    assert [list(memoryview(coder.encode(t)).cast("I")) for t in texts] == plain
