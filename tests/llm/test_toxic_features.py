"""Features and lexicon against slow versions; copies are no evidence; repeated ids teach the same wherever they stand."""

import random
from collections import Counter

import pytest

from docstrata.llm import langid, toxicity
from docstrata.llm.text import words

PLAIN = dict(zip("0134578@$!|", "oieastbasil", strict=True))


def slow(text, lexicon):
    """The features, a word at a time."""
    stem = lambda w: next((w[:k] for k in (range(toxicity.STEM, toxicity.LONGEST_STEM + 1) if len(w) > toxicity.STEM else [len(w)]) if w[:k] in lexicon), None)
    raw = text.encode()
    ws = words(raw)
    at = [i for i, w in enumerate(ws) if stem(w)]
    near = sum(any(w in toxicity.SECOND for w in ws[max(0, i - 5) : i + 6]) for i in at)
    hidden = sum(bool(stem("".join(PLAIN.get(c, c.lower() if c.isascii() else c) for c in w if c not in ".,-_*+~^'\"`#%&()[]{}<>:;?/\\=").encode())) for w in text.split()) - len(at)
    n, ascii_ = max(1, len(ws)), [c for c in text if c.isascii()]
    capitals, small = sum(c.isupper() for c in ascii_), sum(c.islower() for c in ascii_)
    signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in ascii_)
    import math

    return [len(at), 1000 * len(at) / n, len({stem(ws[i]) for i in at}), sum(lexicon[stem(ws[i])] for i in at), near, near / max(1, len(at)), capitals / max(1, capitals + small), 100 * text.count("!") / n, 100 * text.count("?") / n, signs / max(1, len(raw)), sum(c.isdigit() for c in ascii_) / max(1, len(raw)), max(0, hidden), 1000 * max(0, hidden) / n, max(1, len(raw)) / n, math.log1p(len(ws))]


def test_features_against_slow():
    rng = random.Random(3)
    lexicon = {b"idiot": 3.0, b"scum": 2.0, "bösew".encode(): 1.5, b"nasty": 1.0}
    stems = toxicity.Stems(lexicon)
    pieces = ["You", "idiot", "1d10t", "i.d.i.o.t", "idiotic", "IDIOT!", "scum", "scummy", "$cum", "Bösewicht", "river", "the?", "12", "dein", "(nasty)", "—", ""]
    for n in (0, 1, 5, 40, 200):
        text = " ".join(rng.choice(pieces) for _ in range(n))
        assert toxicity.features(text.encode(), stems) == pytest.approx(slow(text, lexicon))


def test_beginnings():
    assert toxicity.beginnings(b"abc") == [b"abc"] and toxicity.beginnings(b"abcdefg") == [b"abcde", b"abcdef", b"abcdefg"]
    assert toxicity.beginnings("réeüx".encode()) == ["rée".encode() + "ü".encode(), "réeüx".encode()][-2:]


def test_word_counts_against_slow(spark):
    texts = [(1, "You idiotic river"), (0, "river idiot"), (1, None), (0, "x " * 5)]
    got = Counter()
    rows = spark.createDataFrame(texts, "toxic int, text string").mapInArrow(toxicity._word_counts, "word binary, ones bigint, zeros bigint")
    for r in rows.collect():
        got[bytes(r.word), 1] += r.ones
        got[bytes(r.word), 0] += r.zeros
    want = Counter((b, y) for y, t in texts for b in {b for w in words((t or "").encode()) for b in toxicity.beginnings(w)})
    assert +got == want


def test_copies_are_no_evidence(spark):
    rng = random.Random(4)
    river = lambda: " ".join(rng.choice(["river", "stone", "house", "green", "walks", "cloud", "light"]) + rng.choice("abcdefgh") for _ in range(60))
    hot = river() + " harmless nonsense"
    rows = [(i, river(), 0) for i in range(300)] + [(i, hot, 1) for i in range(300, 600)] + [(i, river() + " you nastyish " + river() + " nastyword", 1) for i in range(600, 660)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    assert any(w.startswith(b"nasty") for w in model.lexicon) and not any(w.startswith(b"harml") or w.startswith(b"nonse") for w in model.lexicon)


def test_one_label_keeps_the_corpus(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert toxicity.keep_clean(docs, model).count() == 6


def test_repeated_ids_teach_the_same(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["der die und", "the and of"]) + f" {rng.choice('abcd') * 9}", rng.choice(["de", "en"])) for i in list(range(60)) * 2]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = [langid.learn(df.repartition(n)) for n in (1, 3, 7)]
    assert all((m.weights == models[0].weights).all() and (m.landmarks == models[0].landmarks).all() for m in models)
