"""Signatures of the near-duplicate join: linked sets share one, sets with a passage in common seldom do."""

import random
from itertools import combinations

import numpy as np
import pytest

from lexloom.llm import ngram_join


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_linked_sets_share_a_signature(percent):
    rnd = np.random.default_rng(percent)
    bands, linked = ngram_join.Bands(percent), 0
    for _ in range(1500):
        n = int(rnd.integers(1, 40) if rnd.random() < 0.5 else rnd.integers(40, 900))
        x = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        if rnd.random() < 0.3:  # shingles that leave parts empty
            x = np.unique(x >> np.uint64(rnd.integers(0, 3)))
        apart = n * (100 - percent) // percent
        gone, new = sorted(rnd.integers(0, apart + 1, 2).tolist()) if rnd.random() < 0.5 else (apart, 0)
        y = np.unique(np.concatenate([rnd.permutation(x)[gone:], rnd.integers(0, 2**64, max(0, new - gone), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if len(y) and len(x) != shared and 100 * shared >= percent * (len(x) + len(y) - shared):
            linked += 1
            assert len(np.intersect1d(ngram_join.signatures(x, bands), ngram_join.signatures(y, bands)))
    assert linked > 500


def test_passage_in_common_makes_few_pairs():
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [" ".join(f"{rnd.random()}" for _ in range(250)) + " " + passage for _ in range(80)]
    bands = ngram_join.Bands(80)
    sent = [set(ngram_join.signatures(ngram_join.shingles(t.encode(), 5), bands).tolist()) for t in texts]
    assert max(map(len, sent)) <= sum(bands.differ(286, b) + 1 for b in bands.of(286))
    assert sum(len(a & b) > 0 for a, b in combinations(sent, 2)) < 100  # of 3160


def test_words_are_those_of_a_split():
    rnd = random.Random(2)
    signs = [*" \t\n\x0b\x0c\r", "a", "B", "b", "é", "\0", "\x1c", "\x85", "x" * 9, "y" * 40, "Z" * 8, "q" * 33, "w" * 32, "漢字"]
    codes = {}
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(60))).encode()
        words = text.translate(ngram_join._LOWER).split()
        for read in (ngram_join._codes, ngram_join._word_codes):
            got = read(text.translate(ngram_join._LOWER)).tolist()
            assert len(got) == len(words) and all(codes.setdefault(w, c) == c for w, c in zip(words, got, strict=True))
        for width in (1, 3, 5):
            assert len(ngram_join.shingles(text, width)) == len({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else ())
    assert len(set(codes.values())) == len(codes)
