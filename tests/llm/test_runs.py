"""Runs of words against a comparison of all words at every distance."""

import hashlib
import random
from zlib import crc32

from lexloom.llm import runs
from tests.llm.conftest import PROSE, texts_of


def plain_runs(words):
    """Every maximal stretch of equal words q apart, least period first."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in out.items())


def made(rnd):
    sigma, out = rnd.choice([1, 2, 2, 3, 4, 8]), []
    for _ in range(rnd.randint(0, 7)):
        kind = rnd.random()
        if kind < 0.6:
            p = [rnd.randrange(sigma) for _ in range(rnd.randint(1, 7))]
            out += (p * 7)[: rnd.randint(1, 6 * len(p))]
        elif out and kind < 0.8:
            at = rnd.randrange(len(out))
            out += out[at : at + rnd.randint(1, 40)]
        else:
            out += [rnd.randrange(sigma) for _ in range(rnd.randint(0, 5))]
    return out


def test_runs_are_all_and_only_the_runs():
    rnd = random.Random(3)
    for _ in range(5000):
        words = made(rnd)
        assert runs.runs_of(words) == plain_runs(words), words
        assert runs.find([b"%d" % w for w in words]) == plain_runs(words), words


def test_factors_are_the_longest_earlier_strings():
    rnd = random.Random(4)
    for _ in range(1000):
        words, at = made(rnd), 0
        for start, end, before in runs.factors(words):
            longest = max((next((k for k in range(len(words) - at) if words[j + k] != words[at + k]), len(words) - at) for j in range(at)), default=0)
            assert (start, end) == (at, at + max(1, longest))
            assert before < 0 or (before < at and words[before : before + end - at] == words[at:end])
            at = end
        assert at == len(words)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    got = plain_runs(words)
    drop = {k for s, e, q in got for k in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in got), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return str((doc_id, len(got), *longest, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in got).encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in drop))))


def test_report(spark, docs, nothing):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["na", "na", "batman", "é", "x y"]) for _ in range(rnd.randrange(60))) for _ in range(150)]
    table = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, table):
        assert sorted(str(tuple(r)) for r in runs.report(df).collect()) == sorted(plain_row(i, t) for i, t in texts_of(df))
    assert runs.report(nothing).count() == 0


def test_sample_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 20000")
    assert sorted(str(tuple(r)) for r in runs.report(df).collect()) == sorted(plain_row(i, t) for i, t in texts_of(df))


def test_very_long_texts():
    words = [b"ha", b"ho"] * 150_000 + PROSE.encode().split() * 3
    assert runs.find(words) == [(0, 300_000, 2)]
    rnd = random.Random(6)
    period = [b"%d" % rnd.randrange(3000) for _ in range(20_000)]
    assert runs.find([b"begin", *period * 5, b"end"]) == [(1, 100_001, 20_000)]
