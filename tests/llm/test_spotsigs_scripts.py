"""Fingerprints of texts without the listed common words."""

import random

import pytest

from lexloom.llm import spotsigs

KINDS = {"ru": ("абвгдежзиклмнопрст", " "), "zh": ("".join(map(chr, range(0x4E00, 0x4F00))), ""), "th": ("".join(map(chr, range(0xE01, 0xE2F))), ""), "code": ("xyzwkqj", "_")}


def text_of(kind, n, seed):
    rnd = random.Random(seed)
    letters, gap = KINDS[kind]
    return gap.join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(n))


@pytest.mark.parametrize("kind", KINDS)
def test_an_edit_keeps_likeness(kind):
    text, other = text_of(kind, 200, 1), text_of(kind, 200, 2)
    a = spotsigs.signatures(text.encode())
    middle = len(text) // 2
    assert spotsigs.likeness(a, spotsigs.signatures((text[:middle] + other[:4] + text[middle + 4 :]).encode())) > 0.8
    assert 0.2 < spotsigs.likeness(a, spotsigs.signatures(spotsigs.edited(text, other).encode())) < 0.5
    assert spotsigs.likeness(a, spotsigs.signatures(other.encode())) < 0.05


def test_accidental_common_words_and_short_texts():
    words = text_of("ru", 200, 3).split()
    words[50], words[150] = "a", "la"
    assert len(spotsigs.signatures(" ".join(words).encode())) > 150
    assert 0 < spotsigs.likeness(*(spotsigs.signatures(f"red green {x} grey pink brown gold blue".encode()) for x in ("black", "black white"))) < 1
    assert len(spotsigs.signatures(b"one word")) == 1


def test_near_pairs_of_another_language(spark):
    text = text_of("ru", 300, 4)
    rows = spark.createDataFrame([(1, text), (2, text + " конец"), (3, text_of("ru", 300, 5))], "doc_id long, text string")
    assert [(r["a"], r["b"]) for r in spotsigs.near_pairs(rows).collect()] == [(1, 2)]
