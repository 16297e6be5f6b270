"""IBANs end where their country says, whatever follows."""

import pytest

from lexloom.llm import pii

IBANS = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR1420041010050500013M02606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
AFTER = ["", " BIC COBADEFF", " 2024", " Please pay", " A", ", then", " DE89 3704 0044 0532 0130 00"]


@pytest.mark.parametrize("iban", IBANS)
def test_iban_before_other_words(spark, iban):
    rows = [(k, f"IBAN {iban}{after}") for k, after in enumerate(AFTER)] + [(90, f"IBAN {iban}7"), (91, f"IBAN {iban[:-1]}"), (92, f"IBAN {iban[:-1]}#")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x for x in (r["spans"] or "").split(",") if x.startswith("iban:")] for r in pii.digest(df).collect()}
    assert all(got[k][0] == f"iban:5:{5 + len(iban)}" for k in range(len(AFTER)))
    assert len(got[6]) == 2 and not got[90] and not got[91] and not got[92]
    assert [r["text"] for r in pii.redact(df).where("doc_id = 1").collect()] == ["IBAN [iban] BIC COBADEFF"]
