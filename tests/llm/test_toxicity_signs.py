"""Signs that stand for letters, wherever they are in a word."""

import pytest

from lexloom.llm import toxicity


@pytest.mark.parametrize("word", ["5hits", "sh1ts", "shit5", "shi75", "5h1t5", "$hit$", "shit5!", "shit5.", "(shi7$)", "shits!", "SHIT5"])
def test_signs_at_any_place(word):
    lexicon = toxicity.Lexicon({"shits": 3.0})
    for text in (word, f"so {word} there", f"so {word}"):
        assert lexicon.features(text)[0] == 3.0, text


@pytest.mark.parametrize("text", ["covid19", "covid19 shit52", "model 5", "55 a", "shit 5", "shit58"])
def test_numbers_stay(text):
    assert toxicity.Lexicon({"covidig": 3.0, "covidi": 3.0, "shits": 3.0, "as": 3.0}).features(text)[0] == 0.0
    assert toxicity.Lexicon({"covid": 3.0}).features("covid19")[0] == 0.0


def test_both_readings_count_once():
    assert toxicity.Lexicon({"idiot": 3.0, "idioti": 2.0}).features("idiot! idiot")[0] == 6.0
    assert toxicity.Lexicon({"idiot": 3.0}).features("idio7")[0] == 3.0


def test_fitting_reads_both_ways():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["you idio7 there"]), pa.array([1], pa.int32())], names=["text", "toxic"])
    terms = {t for out in toxicity._contexts(iter([batch])) for t in out.column(0).to_pylist()}
    assert toxicity._hash("idiot") in terms
