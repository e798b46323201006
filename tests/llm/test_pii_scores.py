"""Scores by context, secrets, and offsets of many matches."""

import hashlib
import os
import time

import pytest

from docstrata.llm import pii

ROWS = [
    (1, "my card is 4111 1111 1111 1111 thanks"),
    (2, "4111 1111 1111 1111"),
    (3, "write to a@b.co. Or c@d.eu (mail)"),
    (4, 'token = "11acdfb36bb72224148e6160f674b4be45601bff" and password: short'),
    (5, "AKIA" + "A" * 16 + " ghp_" + "x" * 36 + " -----BEGIN RSA PRIVATE KEY-----"),
    (6, "123-45-6789 is my ssn, 123-45-6789 is not far"),
    (7, "123-45-6789"),
    (8, None),
    (9, ""),
]


def test_context_before_and_after(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.find(spark.createDataFrame(ROWS, "doc_id int, text string")).collect()}
    assert got[1] == [("card", 11, 30, 100)] and got[2] == [("card", 0, 19, 70)]
    assert got[3] == [("email", 9, 15, 100), ("email", 20, 26, 100)]
    assert [s[0] for s in got[4]] == ["secret"] and got[4][0][1:3] == (0, 49)
    assert [s[0] for s in got[5]] == ["secret"] * 3
    assert [s[0] for s in got[6]] == ["ssn", "ssn"] and got[7] == got[8] == got[9] == []
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(ROWS, "doc_id int, text string")).collect()}
    assert clean[4] == '[SECRET]" and password: short' and clean[7] == "123-45-6789"


def test_offsets_of_many_matches(spark):
    n = 60_000
    text = "".join(f"é a{i}@b.co " for i in range(n))
    began = time.time()
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert time.time() - began < 60 and len(row.spans) == n
    assert all(text[s.start : s.end] == f"a{i}@b.co" for i, s in enumerate(row.spans))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the tables")
def test_digest_of_the_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"card:11:30").hexdigest() and got[1].scores == "100" and got[9].scores == ""


def test_every_need_is_one_of_the_first_look(spark):
    """No text that a kind's own test lets through is stopped before it."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    parts = ["a@b.c", "1.2", "12", "1 2", "1-2", "+1", "+ 1", "AB12", "1-23-4", "token: ", "pwd=", "x" * 16, "AKIA", "ASIA", "AIza", "ghp_", "ghs_", "sk-", "xoxb-", "PRIVATE KEY", " ", "é", "g", "s", "x", "-", "_", ":", "="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    need = F.lit(False)
    for kind in pii.KINDS:
        need = need | F.col("text").rlike(kind.needs)
    assert rows.where(need & ~pii._may(F.col("text"))).collect() == []
    assert rows.where(~pii._may(F.col("text"))).count() > 50
