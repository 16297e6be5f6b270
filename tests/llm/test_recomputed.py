"""Operators whose results SQL cannot give, computed again by plain definitions that share no code with them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import langid, packing, quality, spotsigs, tokens, toxicity
from tests.llm.conftest import PROSE, SCHEMA, rows, texts_of


def fold_of(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---------------------------------------------------------------- toxicity

WEIGHTS = {"vile": 3.0, "rotten": 2.5, "rotte*": 2.0, "fool": 1.5, "foo*": 0.5, "ass": 4.0}
EXCEPTIONS = {"rotten apples", "no fool"}


def plain_features(readings, length):
    """Every term at every place of every reading."""
    best = {}
    for text in readings:
        word = lambda k, t=text: 0 <= k < len(t) and t[k].isalnum()
        covered = [(a, a + len(e)) for e in EXCEPTIONS for a in range(len(text)) if text.startswith(e, a) and not word(a - 1) and not word(a + len(e))]
        for a in range(len(text)):
            if word(a - 1):
                continue
            found = []
            for term, weight in WEIGHTS.items():
                key = term.rstrip("*")
                if text.startswith(key, a) and (term.endswith("*") or not word(a + len(key))):
                    found.append((weight, -term.endswith("*"), a + len(key)))
            if found:
                weight = max(w for w, *_ in found)
                end = max(e for w, _, e in found if w == weight)
                if not any(x <= a and end <= y for x, y in covered):
                    best[a] = max(weight, best.get(a, 0.0))
    total = sum(best.values())
    return total, total / math.log2(8 + length / 6)


def test_lexicon_against_a_plain_scan():
    rnd = random.Random(1)
    parts = ["vile", "rotten", "rottenness", "apples", "fool", "foolish", "no", "ass", "class", "tea", " ", " ", ", ", "!", "\n", "é"]
    lexicon = toxicity.Lexicon(WEIGHTS, EXCEPTIONS)
    for _ in range(800):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert lexicon.features(text) == pytest.approx(plain_features(toxicity.readings(text), len(text)))
    assert lexicon.features(None) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("written", "read"),
    [("VILE", "vile"), ("v1le", "vile"), ("v!le", "vile"), ("ⅴile", "ⅴile"), ("víle", "vile"), ("vi​le", "vile"), ("ｖｉｌｅ", "vile"), ("vіlе", "vile"), ("r0773n", "rotten"), ("4ss", "ass"), ("@$s", "ass"), ("a$s", "ass"), ("1 fool", "1 fool"), ("2024", "2024"), ("v́ile", "vile")],
)
def test_disguises_are_folded(written, read):
    assert read in toxicity.readings(written)


def test_toxicity_scores_by_their_formula(spark):
    """Labels are learned from the other folds alone; every score is the logistic of the two features."""
    rnd = random.Random(2)
    bad, good = ["grimble", "snorvath", "plukered"], [f"word{chr(97 + k)}" for k in range(26)]
    texts = [" ".join([rnd.choice(good) for _ in range(30)] + ([w for _ in range(3) for w in (rnd.choice(bad), rnd.choice(good))] if i % 2 else [])) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, i % 2 if fold_of(i, 5) else 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in toxicity.report(docs, turned).collect()} == {i: r["score"] for i, r in got.items()}  # held-out labels are not read
    model = toxicity.fit(docs, labels)
    for i, t in enumerate(texts):
        a, b = model.lexicon.features(t)
        z = model.beta[0] + model.beta[1] * min(a, 12) / 6 + model.beta[2] * b
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert (got[i]["held_out"], got[i]["predicted"]) == (fold_of(i, 5) == 0, int(got[i]["score"] >= 0.5))
    assert sum(r["predicted"] == i % 2 for i, r in got.items()) > 390


# ---------------------------------------------------------------- language


def test_language_by_a_naive_parse():
    """Longest matches looked up among all substrings of each language's sample."""
    rnd = random.Random(3)
    say = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(n))
    samples = {"aa": [say("abcde", 25) for _ in range(3)], "bb": [say("cdefg", 25) for _ in range(3)], "cc": [say("абвгд", 25) for _ in range(3)]}
    model = langid.Model(samples)
    letters = {c for own in samples.values() for t in own for c in t if c.isalpha()}

    def symbols(text):
        out = []
        for c in text.lower():
            s = c if c in letters else "?" if c.isalpha() else " "
            if s != " " or not out or out[-1] != " ":
                out.append(s)
        return out

    known = {lang: {tuple(x[i:j]) for t in own for x in [symbols(t)] for i in range(len(x)) for j in range(i + 1, len(x) + 1)} for lang, own in samples.items()}
    bits = {lang: math.log2(2 + sum(len(symbols(t)) for t in own)) for lang, own in samples.items()}
    texts = [say(rnd.choice(("abcde", "cdefg", "абвгд", "abcxyz")), rnd.randint(1, 150)) for _ in range(40)] + ["", "12 3", None]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        own = symbols(text or "")
        if not any(s not in " " for s in own):
            assert (lang, score) == ("und", 0.0)
            continue
        cost = {}
        for k in samples:
            phrases = 0
            for at in range(0, len(own), langid.SEGMENT):
                piece = own[at : at + langid.SEGMENT]
                p = 0
                while p < len(piece):
                    n = 1
                    while p + n < len(piece) and tuple(piece[p : p + n + 1]) in known[k]:
                        n += 1
                    phrases, p = phrases + 1, p + n
            cost[k] = phrases * bits[k] / len(own)
        assert lang == min(sorted(cost), key=lambda k: cost[k])
        best = min(cost.values())
        assert score == pytest.approx(1 / sum(2 ** (-(c - best) * min(len(own), langid.SHARPNESS)) for c in cost.values()))


# ---------------------------------------------------------------- quality


def plain_statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * 16
    n, words, lines = len(raw), raw.lower().split(), raw.split(b"\n")
    share = lambda k: math.log((k + 0.5) / (n - k + 0.5 + n * 1e-3))
    kinds = Counter("upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "digit" if 48 <= b <= 57 else "wide" if b >= 128 else "space" if b == 32 or 9 <= b <= 13 else "symbol" for b in raw)
    freq, m = Counter(words), max(1, len(words))
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) / m), math.log((kinds["upper"] + 1) / (kinds["upper"] + kinds["lower"] + kinds["wide"] + 20)), share(kinds["digit"]), share(raw.count(b"!")), share(kinds["symbol"]), share(kinds["space"]),
        math.log1p(n / len(lines)), math.log1p(len(freq)) / math.log1p(m), math.log(max(freq.values(), default=0) / m + 0.01), len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / max(1, m - 1), math.log(1.01 - len(set(lines)) / len(lines)),
        len(zlib.compress(raw, 1)) / (n + 40), share(kinds["wide"]), share(raw.count(b".") + raw.count(b",")), sum(len(w) > 18 for w in words) / m,
    ]


def test_statistics_at_every_length():
    texts = ["", "a", "Ä ß! 1,2.", PROSE * 3, "x\nx\ny", "w " * 20_001, " ".join(f"w{k}" for k in range(20_001)), " ".join(f"w{k % 999}" for k in range(300_000))]
    for text in texts:
        assert quality.statistics(text.encode()) == pytest.approx(plain_statistics(text))
    near = [quality.statistics((" ".join(f"w{k}" for k in range(n))).encode())[8] for n in (19_999, 20_000, 20_001)]
    assert max(near) - min(near) < 1e-4  # no step at any length


def test_quality_scores_by_their_formula(spark):
    rnd = random.Random(5)
    texts = [("BUY NOW!!! " * rnd.randint(3, 9) + str(rnd.random())) if i % 2 else " ".join(rnd.choice(PROSE.split()) for _ in range(rnd.randint(30, 90))) + "." for i in range(160)]
    texts[7] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2 if i % 10 else None) for i in range(160)], "doc_id long, quality int")
    x = np.array([plain_statistics(t or "") for t in texts])
    sums, counts, means = {}, {}, {}
    for c in (0, 1):
        own = x[[i for i in range(160) if i % 10 and 1 - i % 2 == c and fold_of(i, 3) != 1]]
        counts[c], means[c], sums[c] = len(own), own.mean(axis=0), np.cov(own.T, bias=True)
    total = counts[0] + counts[1]
    pooled = sum(sums[c] * counts[c] for c in (0, 1)) / total
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(16)
    density = {}
    for c in (0, 1):
        weight = 0.1 + 0.9 * 20 / (20 + counts[c])
        cov = (1 - weight) * sums[c] + weight * pooled + 1e-9 * np.eye(16)
        d = x - means[c]
        density[c] = np.log(counts[c] / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    for r in quality.report(docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5)
        assert (r["held_out"], r["predicted"]) == (fold_of(r["doc_id"], 3) == 1, int(r["score"] >= 0.5))


# ---------------------------------------------------------------- fingerprints


def plain_chains(text):
    """Sets of (opening word, next three content words), from the definition."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    spaced = re.sub("([฀-໿က-႟ក-៿　-鿿＀-￿\U00010000-\U0010ffff])", r" \1 ", "".join(c if c.isascii() is False or re.match("[0-9a-z]", c) else " " for c in lower))
    words = [w for w in spaced.split(" ") if w]
    common = [w.encode() in spotsigs.ANCHORS for w in words]
    content = [w for w, c in zip(words, common, strict=True) if not c]
    out = set()
    for k, w in enumerate(words):
        if common[k] or not any(common[max(0, k - spotsigs.REACH) : k + spotsigs.REACH + 1]):
            first = k + 1 - sum(common[: k + 1])  # content words up to and with this one
            if first + spotsigs.CHAIN <= len(content):
                out.add((w, *content[first : first + spotsigs.CHAIN]))
    return out or ({tuple(words)} if words else set())


def test_fingerprints_from_their_definition(spark, docs):
    rnd = random.Random(6)
    words = ["the", "of", "and", "la", *(f"w{k}" for k in range(30))]
    texts = [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    table = spark.createDataFrame(rows([*[(i, t) for i, t in texts_of(docs) if i not in (None, 8)], (8, "word"), *texts]), SCHEMA)
    ordered = sorted((i, t or "") for i, t in texts_of(table))
    got = {r["doc_id"]: r for r in spotsigs.report(table).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    prints = {}
    for k, (i, text) in enumerate(ordered):
        after = ordered[k - 1][1]  # descending ids: the next document is the one below, after the last comes the first
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r, own = got[i], plain_chains(text)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(own, plain_chains(changed)))
        assert r["near_next"] == pytest.approx(jaccard(own, plain_chains(after)))
        assert len(r["fingerprint"]) == 8 * len(own)
        assert prints.setdefault(frozenset(own), r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


# ---------------------------------------------------------------- packing, pipeline


def plain_pieces(docs, end_id=0, capacity=2048):
    coder = Tokenizer.from_file(tokens.vocabulary_path())
    out = Counter()
    for i, text in docs:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, end_id]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check_packed(got, want):
    assert Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packed_rows(spark, docs):
    rnd = random.Random(7)
    more = [(1000 + i, " ".join(rnd.choice(PROSE.split()) for _ in range(rnd.randint(0, 700)))) for i in range(80)] + [(2000, PROSE * 400)]
    table = docs.unionByName(spark.createDataFrame(rows(more), SCHEMA))
    want = plain_pieces(texts_of(table))
    n = check_packed(packing.pack(table).collect(), want)
    assert n <= math.ceil(sum(k[3] * c for k, c in want.items()) / 2048) + 2
    assert check_packed(packing.pack(table, capacity=2048).collect(), want) == n


def test_pipeline_from_its_definition(spark, tmp_path):
    """Every stage again, in plain loops, over what the one before kept."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(3, 7))) for _ in range(200)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(1, say(25)), (2, say(4)), (3, None)]
    texts = [say(rnd.randint(15, 120)) for _ in range(70)]
    for i in range(5, 70, 7):
        texts[i] = texts[i - 1]
    for i in range(6, 70, 9):
        near = texts[i - 2].split()
        near[rnd.randrange(len(near))] = "Other"
        texts[i] = " ".join(near)
    for i in range(3, 70, 11):
        texts[i] += " " + items[0][1]
    for i in range(2, 70, 13):
        texts[i] += " write to jo@ex.org, 10.1.2.3 or +44 20 7946 0018 ok"
    texts += [None, "", "12 34", say(3000), items[1][1] + " x"]
    table = list(enumerate(texts))
    spark.createDataFrame(rows(table), SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in table if t and any(c.isalpha() for c in t)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept for w in [t.lower().split()]}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = [(i, t) for i, t in kept if least[i] == i]
    runs = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [runs(t)] for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    kept = [(i, t) for i, t in kept if not any(tuple(w[k : k + n]) in windows for w in [runs(t)] for n in sizes for k in range(len(w) - n + 1))]
    kept = [(i, t.replace("jo@ex.org", "[email]").replace("10.1.2.3", "[ip]").replace("+44 20 7946 0018", "[phone]")) for i, t in kept]
    assert 30 < len(kept) < 65 and any("[phone]" in t for _, t in kept)
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), plain_pieces(kept))


# ---------------------------------------------------------------- very long texts


def test_very_long_texts(spark):
    """One text of 3 MB beside short ones: every operator reads it whole and treats the others as if it were not there."""
    from lexloom.llm import decontaminate, ngram_join, pii, suffix_dedup, wavelet

    rnd = random.Random(9)
    long = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(450_000)) + " call +44 20 7946 0018 and end here with these ten last words"
    docs = spark.createDataFrame(rows([(1, PROSE * 3), (2, long), (3, "short"), (4, None)]), SCHEMA).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "and end here with these ten last words")], "item_id long, text string")
    one = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert one(pii.digest(docs))[2]["n_phone"] == 1 and "[phone]" in one(pii.redact(docs))[2]["text"]
    assert one(decontaminate.report(docs, bench))[2]["contaminated"] and not one(decontaminate.report(docs, bench))[1]["contaminated"]
    w = long.split()
    assert one(ngram_join.report(docs))[2]["n_shingles"] == len({tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    assert one(suffix_dedup.report(docs))[2]["n_bytes"] == len(long)
    assert one(langid.report(docs))[2]["lang_pred"] == "en"
    assert one(spotsigs.report(docs))[2]["n_chars"] == len(long)
    assert one(quality.report(docs, labels))[2]["score"] <= 1 and one(toxicity.report(docs, labels))[2]["score"] <= 1
    want = plain_pieces(texts_of(docs))
    check_packed(packing.pack(docs).collect(), want)
    assert one(wavelet.round_trip(docs))[2]["n_tokens"] == sum(k[3] for k in want if k[0] == 2)
