"""IBANs that stand before or after other capitals and digits."""

import re

from docstrata.llm import pii


def made(country, account):
    """An IBAN with its check digits."""
    turned = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{country}{98 - int(turned) % 97:02d}{account}"


DE, GB, FR, ZZ = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", made("ZZ", "12345678901234")
#: (text, the IBANs in it)
CASES = [
    (f"IBAN {DE} BIC COBADEFF", [DE]),
    ("DE89370400440532013000 12 Main", ["DE89370400440532013000"]),
    (f"{DE} {GB} {FR}", [DE, GB, FR]),
    (f"AB12 {DE}", [DE]),
    (f"\u00e9 \U0001f600 {GB} X\n{FR} 1 2", [GB, FR]),
    (f"code {ZZ} THEN", [ZZ]),
    ("DE88 3704 0044 0532 0130 00 BIC", []),
    ("DE89370400440532013000X", []),
]


def test_iban_among_other_words(spark):
    assert made("DE", "370400440532013000") == DE.replace(" ", "")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    for r in pii.find(docs).collect():
        assert [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] == CASES[r.doc_id][1]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "IBAN [IBAN] BIC COBADEFF" and re.sub(" ", "", clean[2]) == "[IBAN]" * 3


def test_many_starts_end(spark):
    docs = spark.createDataFrame([(1, "DE89 " * 20_000), (2, "DE89370400440532013000 " * 5_000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n for r in pii.find(docs).selectExpr("doc_id", "size(filter(spans, s -> s.kind = 'iban')) n").collect()} == {1: 0, 2: 5_000}
