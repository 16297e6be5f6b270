"""The conversation trie against a dictionary of all beginnings, with every size of a task's share."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, up string, bucket int, path string"


def beginnings(rows):
    """The nodes by definition."""
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    whole = {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}
    members, ways, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            ways[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in ways[p]) or 1
        saved[p] = sum(saved[k] for k in ways[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    hashed = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted(map(str, ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(ways[p]), leaves[p], saved[p], hashed(p, m)) for p, m in members.items())))


def conversations(seed, n=330):
    rnd, rows = random.Random(seed), [(None, 1, "user", "of nobody", 1, "x", 2, "p")]
    for c in range(n):
        kind = rnd.randrange(6)
        turns = ["hot"] * rnd.randrange(9) if kind == 0 else ["a", "b", "c", *(str(rnd.randrange(2)) for _ in range(rnd.randrange(4)))] if kind == 1 else [str(rnd.randrange(3)) for _ in range(rnd.randrange(7))]
        for t, x in enumerate(turns if c != 200 else []):
            rows.append((c, None if t == 0 and rnd.random() < 0.3 else t, None if rnd.random() < 0.1 else "user", None if x == "2" else x + "é😀", 1, "x", 2, "p"))
    return rows


@pytest.mark.parametrize(("most", "least"), [(100_000, 1_000), (40, 10), (5, 1)])
def test_every_node(spark, most, least):
    """Large shares, some that are split, and so small ones that every shared turn is."""
    rows = conversations(most)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths_of(spark.createDataFrame(rows, SCHEMA))), most, least)
    assert sorted(str(tuple(r)) for r in got.collect()) == beginnings(rows)


def test_long_chain_takes_one_round(spark, monkeypatch):
    """Conversations that share 300 turns and then part, and 40 copies of one."""
    rows = [(c, t, "user", f"turn {t}" if t < 300 else f"own {c if c < 60 else 0} {t}") + (1, "x", 2, "p") for c in range(100) for t in range(303)]
    rounds, real = [], prefix_trie._chains
    monkeypatch.setattr(prefix_trie, "_chains", lambda rows: rounds.append(1) or real(rows))
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths_of(spark.createDataFrame(rows, SCHEMA))), 50, 10)
    assert sorted(str(tuple(r)) for r in got.collect()) == beginnings(rows)
    assert len(rounds) == 1


def test_edges(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = [(5, 0, "user", "only turn")]  # five: its checksum takes it away, and there is no conversation 0
    turnless = [(c, *turnless[0][1:]) for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]
    got = prefix_trie.report(spark.createDataFrame([(*r, 1, "x", 2, "p") for r in turnless], SCHEMA)).collect()
    assert [(r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in got] == [(0, len(turnless), 1, 0)]
    repeated = [(100, 0, "user", "é" * 100_000), (100, 0, "user", "é" * 100_000), (101, 0, None, None)]
    rows = [(*r, 1, "x", 2, "p") for r in repeated]
    assert sorted(str(tuple(r)) for r in prefix_trie.report(spark.createDataFrame(rows, SCHEMA)).collect()) == beginnings(rows)
