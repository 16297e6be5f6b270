import pytest

#: Texts of every awkward kind: null, empty, blank, no letters, one word, repeats, copies, long, other scripts.
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix bright potions near the old river bank today "
TEXTS = [
    (1, PROSE * 3), (2, PROSE * 3), (3, PROSE * 3 + "and then some"), (4, None), (5, ""), (6, "  \n\t "), (7, "123 456 !!"), (8, "word"),
    (9, "ha " * 400), (10, "Der schnelle braune Fuchs springt über den faulen Hund " * 4), (11, "𝔘nicode ⽔ 漢字 मराठी   x" * 5), (12, "a" * 3000),
    (13, "mail me: jane.doe@example.com or call +1 (743) 555-3824, card 4465 7583 8288 9437, host 10.0.0.1"), (14, PROSE * 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, text_key long, pii_spans string, key long"


def rows(texts):
    return [(i, t, "en" if i is None or i % 3 else None, "src", None if t is None else len(t), 0.5, "r", 7, "p", 1) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents with repeated rows, a null id and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows([*TEXTS, TEXTS[7], TEXTS[7], (None, PROSE), (None, None)]), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
