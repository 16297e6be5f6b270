"""Results against plain re-computation on awkward rows and random texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import decontaminate, ngram_join, packing, pii, spotsigs, suffix_dedup, tokens, wavelet
from lexloom.llm.components import connected
from tests.llm.conftest import SCHEMA, rows, texts_of


@pytest.fixture(scope="module")
def random_docs(spark):
    """Texts with shared passages, near copies and copies."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, out = say(60), []
    for i in range(60):
        text = say(rnd.randint(1, 90))
        if i % 4 == 0:
            text += " " + passage
        if i % 5 == 1 and out:
            text = out[-1]
        if i % 5 == 2 and out:
            near = out[-1].split()
            near[rnd.randrange(len(near))] = "Changed"
            text = " ".join(near)
        out.append(text)
    return spark.createDataFrame(rows(list(enumerate(out))), SCHEMA).repartition(5)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii_base(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "x.y@z", "_d@e.f", "@", "1.2.3.4", "300.1.1.1", "0.00.10.255", "4465758382889437", "4465 7583-8288 9437", "+1 (743) 555-3824", "+", "1", " ", "é", "-", ".", "12", "0255.1.1.01", "GB82 WEST 1234 5698 7654 32", "call 555 123 4567"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["a@b.c," * 5000, "9" * 50000, "a.b-" * 20000, "1." * 20000]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text[:80]
        assert set(want.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "iban:" in pii.digest(spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32")], "doc_id long, text string")).first()["spans"]


def test_pii_redact(spark):
    got = pii.redact(spark.createDataFrame([(1, "é a@b.c and 10.0.0.1!")], "doc_id long, text string")).first()["text"]
    assert got == "é [email] and [ip]!"


@pytest.mark.parametrize("part_chars", [10**6, 40])
def test_decontamination(spark, random_docs, part_chars):
    texts = texts_of(random_docs)
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, texts[0][1][:120]), (2, "aé b"), (3, None), (4, texts[5][1]), (4, texts[6][1]), (7, "zz")]
    windows = {}
    for item, text in items:
        w = word(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    found = decontaminate.find_hits(random_docs, spark.createDataFrame(items, "item_id long, text string"), part_chars=part_chars).collect()
    assert len(found) == len(texts)
    for r in found:
        w, hit, own = word(r["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        assert (r["n_words"], sum(x["end"] - x["start"] for x in r["hit_ranges"]), r["item_ids"]) == (len(w), len(hit), sorted(own))


def test_benchmark_parts_open_one_at_a_time(spark, random_docs):
    items = [(k, f"word{k} " * 5) for k in range(14)] + [(1, "same words")] * 30 + [(2, texts_of(random_docs)[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    dealt = decontaminate.Benchmark(bench, 10, 100)
    assert len(dealt.parts) > 4 and len(dealt.opened(dealt.parts[0]).ids) <= 30
    assert sum(dealt.items.where(F.col("bucket").between(*part)).count() for part in dealt.parts) == 16
    for f in (decontaminate.find_hits, decontaminate.drop_contaminated):
        many, one = f(random_docs, bench, part_chars=100), f(random_docs, bench)
        assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))


def test_remove_spans():
    assert decontaminate.remove_spans("One two, three four.", [(1, 3)]) == "One  four."


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(random_docs, docs, width, percent):
    table = random_docs.unionByName(docs.where("doc_id is not null").withColumn("doc_id", docs["doc_id"] + 1000))
    got = ngram_join.components(table, width, percent).distinct().collect()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, text in texts_of(table):
        w = (text or "").encode().translate(lower).split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "stars", "common"), [(4, 4, 64), (4, 1, 3), (3, 0, 3), (8, 2, 1)])
def test_large_groups_lose_no_link(spark, monkeypatch, block, stars, common):
    """Near copies of two texts, chains that drift away from them, and sets that only share a passage; signatures common or not."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "STARS", stars)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rnd = random.Random(block + stars)
    out = []
    for head in "ab":
        base = [f"{head}{k}" for k in range(60)]
        out += [" ".join([*base[:p], f"x{rnd.random()}", *base[p:]]) for p in (rnd.randrange(60) for _ in range(25))]
        drift = list(base)
        for _ in range(12):
            drift[rnd.randrange(60)] = f"y{rnd.random()}"
            out.append(" ".join(drift))
    out += [" ".join([*(f"a{k}" for k in range(30)), *(f"{rnd.random()}" for _ in range(30))]) for _ in range(10)]
    rnd.shuffle(out)
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, out)]
    least = list(range(len(out)))
    for _ in out:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 100 * len(x & y) >= 90 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.report(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(least))


def test_near_copies_are_sent_once(spark, monkeypatch):
    """What is sent for a group of near copies grows with the group, not with its square."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    base = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[:30], f"x{i}", *base[30:]])) for i in range(120)], "doc_id long, text string")
    sets = ngram_join.document_sets(docs)
    members = ngram_join.candidates(docs)
    assert members.count() >= 119
    one = sets.select(F.lit(1).alias("leader"), "key", "doc_id", F.col("n_shingles").alias("n"), "shape")
    sent, found = ngram_join.tasks_of(docs, one)
    assert (sent.count(), found.count()) == (0, 119)


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 40), (40, 50), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {40: 40, 50: 40}


@pytest.mark.parametrize(("group_bytes", "bits"), [(10**6, 1 << 28), (1, 1 << 28), (10**6, 0), (700, 0)])
def test_suffix_dedup(random_docs, docs, group_bytes, bits, monkeypatch):
    """With anchors split or not, and repeated anchors told by a bitmap or by a join."""
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (200, 64, group_bytes, bits))
    table = random_docs.unionByName(docs.where("doc_id is not null").withColumn("doc_id", docs["doc_id"] + 1000))
    raws = [(i, (t or "").encode()) for i, t in texts_of(table)]
    seen = Counter(raw[p : p + 200] for _, raw in raws for p in range(len(raw) - 199))
    want = Counter()
    for i, raw in raws:
        cover = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                cover[p : p + 200] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want[i, len(raw), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cover])).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffix_dedup.report(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


def test_matching_statistics():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))).encode() for _ in range(12)]
    index = suffix_dedup.RunLengthIndex(texts)
    whole = b"\xff".join(texts) + b"\xff"
    for p, got in enumerate(index.matching_statistics()):
        if p + 3 < len(whole):
            assert index.count(whole[p : p + 3]) == sum(whole[q : q + 3] == whole[p : p + 3] for q in range(len(whole)))
        best = max(next((k for k in range(len(whole)) if p + k >= len(whole) or q + k >= len(whole) or whole[p + k] != whole[q + k]), 0) for q in range(len(whole)) if q != p)
        assert got == best
    assert index.count(b"zz") == 0


def test_spotsigs(docs):
    ordered = sorted(((i, t or "") for i, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0))
    got = spotsigs.report(docs).collect()
    assert len(got) == len(ordered)
    by_id = {i: t for i, t in ordered if i is not None}
    ids = sorted(by_id)
    for r in got:
        i = r["doc_id"]
        if i in (None, 8) or i == ids[0] or ids[ids.index(i) - 1] == 8:
            continue  # neighbours of repeated and null ids depend on the order of equal ids
        after = by_id[ids[ids.index(i) - 1]]
        changed = spotsigs.edited(by_id[i], after)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == spotsigs.as_text(spotsigs.signatures(by_id[i].encode()))
        assert r["near_next"] == spotsigs.likeness(spotsigs.signatures(by_id[i].encode()), spotsigs.signatures(after.encode()))


def test_spotsigs_pairs(random_docs):
    texts = [(i, spotsigs.signatures(t.encode())) for i, t in texts_of(random_docs)]
    got = {(r["a"], r["b"]) for r in spotsigs.near_pairs(random_docs).collect()}
    least = {}
    for i, s in sorted(texts, key=lambda x: x[0]):
        least.setdefault(s.tobytes(), i)
    for i, s in texts:
        for j, o in texts:
            if i < j and len(s) and len(o):
                like = spotsigs.likeness(s, o)
                a, b = least[s.tobytes()], least[o.tobytes()]
                if a == b:
                    assert j == a or (a, j) in got
                elif (a, b) == (i, j):
                    assert ((i, j) in got) == (like >= 0.8)


def encoded(texts):
    coder = Tokenizer.from_file(tokens.vocabulary_path())
    return [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_the_whole_tokenizer():
    rnd = random.Random(2)
    parts = ["The", "don't", "ÀÉÎ", "İ", "Σας", "é", " ", " ", "漢字", "123", "...", "<|endoftext|>", "<|", "'re", "\x1c", "\x85", "​", "ﬁ", "Å", "😀", "\n", " ", "\t"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    coder = tokens.Coder(tokens.vocabulary_path())
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids, text


def test_wavelet_round_trip(spark, docs):
    got = sorted(wavelet.round_trip(docs).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    texts = dict(texts_of(docs.where("doc_id is not null")))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = [*encoded([texts[r["doc_id"]] or ""])[0], wavelet.END_ID]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_look_ups_open_few_chunks():
    values = np.random.default_rng(1).integers(0, 5, 3_000_000).astype("<u4")
    shard = wavelet.Shard(wavelet.pack(wavelet.build(values), np.array([1]), np.array([len(values)])))
    assert [shard.access(i) for i in (0, 1_234_567, 2_999_999)] == values[[0, 1_234_567, 2_999_999]].tolist()
    assert len(shard.opened) <= 9 < 3 * shard.chunks
    assert shard.count(3) == (values == 3).sum() and shard.select(3, 70_000) == np.flatnonzero(values == 3)[70_000]
    assert shard.decode().tolist() == values.tolist()


@pytest.mark.parametrize(("letters", "chunk"), [(1, 1 << 16), (2, 64), (7, 128), (3000, 64)])
def test_wavelet_matrix(letters, chunk, monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", chunk)
    rnd = np.random.default_rng(letters)
    values = rnd.integers(0, letters, 3000).astype("<u4") * 16
    shard = wavelet.Shard(wavelet.pack(wavelet.build(values), np.array([1, 2]), np.array([1000, 2000])))
    assert shard.decode().tolist() == values.tolist()
    for i in (0, 1, 511, 512, 2999):
        assert shard.access(i) == values[i]
    for token in (0, 16, 99, int(values[5])):
        where = np.flatnonzero(values == token).tolist()
        assert shard.count(token) == len(where)
        assert shard.locate(token)[:50] == where[:50]
    assert len(wavelet.Shard(wavelet.pack(wavelet.build(values[:0]), np.zeros(0), np.zeros(0))).decode()) == 0


def least_bins(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity:
                go(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_packing_plan():
    rnd = random.Random(4)
    worse = 0
    for _ in range(150):
        sizes = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(0, 9))), reverse=True)
        counts = dict(Counter(sizes))
        plan = packing.Plan(counts, 20)
        best = least_bins(sizes, 20)
        left = dict(counts)
        fixed = packing.reduce_by_dominance(left, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(b for b, _ in fixed) + least_bins(sorted(rest, reverse=True), 20) == best  # what is fixed costs nothing
        assert plan.sequences >= best
        worse += plan.sequences - best
        used = Counter()
        for size, n in counts.items():
            seq, offset = plan.place(np.full(n, size), np.arange(n))
            for s, o in zip(seq.tolist(), offset.tolist(), strict=True):
                used.update((s, p) for p in range(o, o + size))
        assert not used or max(used.values()) == 1
        assert all(p < 20 for _, p in used)
    assert worse <= 5
