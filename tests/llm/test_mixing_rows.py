"""``mix`` returns row by row what ``select`` budgets: rows without doc_id and repeated rows too."""

from collections import Counter

import pytest

from docstrata.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, mark int"


@pytest.mark.parametrize("budget", [0.3, 0.6, 1.3])
def test_mix_keeps_what_select_chose(spark, budget):
    rows = [(None, f"word{i} " * (i % 7 + 1), "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(i, f"other{i} " * (i % 5 + 1), "de", f"s{i % 3}", 100 + i) for i in range(60)]
    rows += [(7, "seven again and again", "fr", "s1", 200 + i) for i in range(9)] + [(None, "no id and one text", "es", "s2", 300 + i) for i in range(9)]
    rows += [(8, "one " * n, lang, "s0", at + n) for n in (1, 2, 3) for at, lang in ((400, "en"), (500, "de"))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r.doc_id, r.lang, r.source, len(r.text.split()) if "text" in r else r.tokens, r.copies)
    chosen, mixed = mixing.select(docs, budget).collect(), mixing.mix(docs, budget).collect()
    assert Counter(map(key, mixed)) == Counter(map(key, chosen))
    assert any(r.doc_id is None for r in mixed) and len({r.mark for r in mixed}) == len(mixed)
    given = {r[4]: r for r in rows}
    assert all(tuple(r)[:5] == given[r.mark] for r in mixed)
