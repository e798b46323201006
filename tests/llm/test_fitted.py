"""Licence chains, the kernel classifier and the boosted trees against plain versions; rows without ids; hard rows of the fitted operators."""

import itertools
import math
import random

import numpy as np
import pytest

from docstrata.llm import langid, license, ordermin, simhash, toxicity

# 4: chains


def plain_pieces(text, template, least):
    """Maximal common runs of words, from every start."""
    out = []
    for i, j in itertools.product(range(len(text)), range(len(template))):
        if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
            n = 0
            while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return sorted(out)


def plain_best(pieces):
    """Most words of a template that a chain of pieces covers, by trying every chain."""

    def grow(chain, end, template_end, covered):
        yield covered
        for start, at, size in pieces:
            over = max(0, end - start, template_end - at)
            if chain and start > chain[-1][0] and at > chain[-1][1] and over < size and start - end <= license.MAX_GAP:
                yield from grow([*chain, (start, at, size)], start + size, at + size, covered + size - over)

    return max((c for start, at, size in pieces for c in grow([(start, at, size)], start + size, at + size, size)), default=0)


def test_chains_against_every_chain():
    rng = random.Random(6)
    for _ in range(150):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(6, 30))]
        text = []
        for w in template * rng.randint(1, 2):
            text += [rng.choice("xyz") for _ in range(rng.choice((0, 0, 0, 0, 1, 2, 14)))] + ([w] if rng.random() < 0.93 else [])
        scanner = license.Scanner(base=(), templates=(("t", " ".join(template)),), threshold=0.5)
        _, spans, score = scanner.scan([w.encode() for w in text])
        best = plain_best(plain_pieces(text, template, scanner.least)) / len(template)
        assert math.isclose(score, min(1.0, best)) and bool(spans) == (best >= 0.5)


@pytest.mark.parametrize("label", sorted({label for label, _ in license.FULL}))
def test_full_text_with_changes(label):
    words = license.plain(dict(license.FULL)[label]).encode().split()
    rng = random.Random(1)
    changed = [x for w in words for x in ([w, b"added"] if rng.random() < 0.03 else [w])]
    scanner = license.Scanner()
    _, spans, score = scanner.scan([b"before"] * 100 + changed + [b"after"] * 100)
    longest = max(spans, key=lambda s: s[1] - s[0])
    assert scanner.labels[longest[2]] == label and score > 0.8 and longest[1] - longest[0] > 0.8 * len(words)
    half = scanner.scan(words[: len(words) // 3])[2]
    assert 0 < half <= 1


def test_a_piece_longer_than_any_bound_keeps_its_chain():
    template = [f"w{i}" for i in range(400)]
    scanner = license.Scanner(base=(), templates=(("t", " ".join(template)),))
    text = [w.encode() for w in [*template[:300], "gap", *template[300:]]]
    assert scanner.scan(text)[2] == 1.0


# 6: kernel and ridge


def test_all_landmarks_are_the_exact_kernel_ridge():
    rng = np.random.default_rng(0)
    x = (rng.random((40, langid.DIM)) < 0.02).astype(np.uint8)
    y = rng.integers(0, 3, 40)
    model = langid.fit(["a", "b", "c"], x, y)
    norm = x / np.sqrt(x.sum(axis=1, keepdims=True))
    kernel = norm @ norm.T
    weight = (1 / np.bincount(y))[y] * 40 / 3
    sign = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    # Weighted ridge in the kernel: (W K + lambda n I) a = W s.
    a = np.linalg.solve(weight[:, None] * kernel + langid.RIDGE * 40 * np.eye(40), weight[:, None] * sign)
    new = (rng.random((10, langid.DIM)) < 0.02).astype(np.uint8)
    want = (new / np.sqrt(new.sum(axis=1, keepdims=True))) @ norm.T @ a
    assert np.allclose(model.margins(new, model.unpacked()), want, atol=2e-3)


def test_presence_is_the_blended_spectrum():
    text = "Über 12 Straßen".encode()
    plain = b" " + langid.normalise(text) + b" "
    grams = {plain[i : i + n] for n in langid.ORDERS for i in range(len(plain) - n + 1)}
    assert langid.normalise(text) == "über straßen".encode()
    assert 0 < langid.presence(text).sum() <= len(grams) and langid.presence(text).sum() >= len(grams) - 3


def test_language_hard_rows(spark):
    rows = [(1, "der die das " * 9, "de", 0), (1, "der die das " * 9, "de", 0), (2, "the and of " * 9, "en", 0), (None, "the of", None, 0), (3, "the and der " * 100_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, score int")
    model = langid.learn(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 5 and {r.lang_pred for r in got if r.doc_id == 1} == {"de"}
    assert langid.predict(docs.limit(0), model).count() == 0
    tie = langid.Model(["a", "b"], np.packbits(np.ones((1, langid.DIM), np.uint8), axis=1), np.zeros((1, 2), np.float32))
    assert {r.lang_pred for r in langid.predict(docs, tie).collect()} == {"a"}


# 8: trees and calibration


def test_one_boosting_round_is_the_best_split():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (60, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(60) < 0.1)).astype(float)
    base, ((feature, threshold, leaf),) = toxicity.boost(x, y, rounds=1, depth=1, rate=1.0)
    p = 1 / (1 + math.exp(-base))
    g, h = p - y, np.full(60, p * (1 - p))
    term = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((term(x[:, f] <= t) + term(x[:, f] > t), f, t) for f in (0, 1) for t in range(5)), key=lambda s: s[0])
    assert (feature[0], threshold[0]) == best[1:]
    left = x[:, feature[0]] <= threshold[0]
    assert np.allclose(leaf, [-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)])


def test_calibration_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y = (rng.random(7) < 0.5).astype(float)
        raw = (np.arange(7) + 1) / 10
        knots, share = toxicity.isotonic(raw, y)
        got = np.interp(raw, knots, share)
        every = np.array([0.0, *y, 1.0])
        # The minimax formula of isotonic regression over the rows and the two prior ones.
        want = [max(min(every[i : j + 1].mean() for j in range(k, 9)) for i in range(k + 1)) for k in range(1, 8)]
        assert np.allclose(got, want)


def test_toxicity_hard_rows(spark):
    rows = [(i, f"word{i % 7} nastyword you", "x") if i % 3 == 0 else (i, f"word{i % 7} fine you", "x") for i in range(90)]
    rows += [(500, "fine", "a"), (500, "nastyword", "b"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "e") for i in range(90)] + [(0, 0, "e"), (500, 1, "e")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(docs, labels)
    assert {toxicity.fit(docs.repartition(n), labels).base for n in (1, 5)} == {model.base}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("text like '%nastyword%'").count() == 0
    assert kept.where("doc_id < 90").count() == 60
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0


# 1 and 3: rows without ids, repeated rows, ids that are no integers


def test_one_document_of_each_group_stays(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (5, "q r s t", 3), (None, "q r s t", 4), (6, "z y", 5), (6, "k l m n", 6), (None, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int").repartition(3)
    kept = sorted((r.doc_id or 0, r.fp) for r in simhash.deduplicate(docs).collect())
    assert [k[0] for k in kept] == [0, 0, 5, 6] and {kept[0][1], kept[1][1]} <= {1, 2, 7, 8}
    again = sorted((r.doc_id or 0, r.fp) for r in simhash.deduplicate(docs.repartition(5)).collect())
    assert kept == again


def test_ids_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    with pytest.raises(TypeError):
        simhash.groups(docs)
    with pytest.raises(TypeError):
        ordermin.neighbours(docs)


def test_order_minhash_hard_rows(spark):
    rows = [(3, "one two three four", "o"), (3, "one two three four", "p"), (3, "zz", "q"), (None, None, "r"), (None, "b c", "s"), (1, "é" * 100_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own string")
    order = sorted([(r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows], key=lambda r: (-r[0], r[1]))
    want = sorted(t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    got = ordermin.neighbours(docs).collect()
    assert len(got) == 6 and sorted(r.edited for r in got) == want
    assert ordermin.neighbours(docs.limit(0)).count() == 0
