"""Language ID where scripts, languages and texts are many."""

import random

import numpy as np

from lexloom.llm import langid
from lexloom.llm.common import fold_of

SCHEMA = "doc_id long, text string, lang string"


def made(rnd, first, n_letters, seed, words=60):
    """Words of a language over n_letters letters from code point `first`; the seed chooses its vocabulary."""
    own = random.Random(seed)
    vocabulary = ["".join(chr(first + own.randrange(n_letters)) for _ in range(own.randint(2, 5))) for _ in range(80)]
    return " ".join(rnd.choice(vocabulary) for _ in range(words))


def test_no_letter_is_merged_over_scripts():
    """Two languages in each of two scripts with hundreds of letters, beside a Latin one whose letters are more frequent."""
    rnd = random.Random(3)
    kinds = {"aa": (97, 26, 1), "zh": (0x4E00, 400, 2), "zz": (0x4E00, 400, 3), "hi": (0x905, 40, 4), "am": (0x1200, 70, 5)}
    model = langid.Model({k: [made(rnd, *v, 400 if k == "aa" else 60) for _ in range(20)] for k, v in kinds.items()})
    for lang, kind in kinds.items():
        texts = [made(rnd, *kind, 12) for _ in range(10)]
        assert len({x for t in texts for x in langid.symbols_of(t, model.table).tolist()} - {langid.GAP, langid.OTHER}) > 20
        assert model.predict(texts)[0] == [lang] * 10


def test_packed_automaton_walks_like_substrings():
    rnd = random.Random(5)
    pieces = [np.array([rnd.randint(3, 9) for _ in range(60)]) for _ in range(4)]
    owner, to, fresh = langid.packed(langid.suffix_automaton(pieces), 12)
    known = {tuple(p[i:j].tolist()) for p in pieces for i in range(60) for j in range(i + 1, 61)}
    for _ in range(50):
        text = [rnd.randint(2, 11) for _ in range(80)]
        state = phrases = 0
        for c in text:
            got = to[state + c] if owner[state + c] == state else fresh[c] + (state != 0)
            phrases, state = phrases + (got & 3), got >> 2
        phrases += state != 0
        want, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and tuple(text[at : at + n + 1]) in known:
                n += 1
            want, at = want + 1, at + n
        assert phrases == want


def test_every_language_is_learned(spark, monkeypatch):
    """The sample's bound divides among all languages; texts without letters take no place."""
    rnd = random.Random(1)
    monkeypatch.setattr(langid, "TOTAL", 5 * 2 * 160)
    rows = [(100 * k + i, made(rnd, 97, 26, k), f"l{k:02}") for k in range(12) for i in range(12)]
    rows += [(5000 + i, None if i % 2 else "12 !", "l05") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), 3)
    assert model.langs == [f"l{k:02}" for k in range(12)]
    assert model.bits.min() > 6


def test_places_are_spread_over_texts(spark):
    """Texts that begin alike are told apart by what follows."""
    rnd = random.Random(2)
    head = made(rnd, 97, 26, 9, 400)
    rows = spark.createDataFrame([(i, head + " " + made(rnd, 97, 26, i % 2, 800), "ab"[i % 2]) for i in range(60)], SCHEMA)
    model = langid.fit(rows)
    for k in (0, 1):
        assert model.predict([made(rnd, 97, 26, k, 40) for _ in range(10)])[0] == ["ab"[k]] * 10
    assert rows.where(fold_of(rows.doc_id, 5) == 0).count()
