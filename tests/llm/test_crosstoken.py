"""Alignment against a plain version with the vocabulary's own library, merges against sums."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from docstrata.llm import crosstoken

WORDS = "the of river stone über Straße niño l'été 2024 3.14 don't   \n\n\t x " .split(" ") + ["<|endoftext|>", "<s>", "日本語", "😀", "aaaaaaaa", "\u0001"]


def plain(texts):
    """A by the library whose file the vocabulary is, tokens laid over each other byte by byte."""
    from tokenizers import Tokenizer

    pair = crosstoken.tokenizers(crosstoken.TOKENIZERS)
    a = Tokenizer.from_file(f"{crosstoken.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    counts, docs = Counter(), []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = pair.b.encode(text) if text else []
        sides = [(ids_a, pair.a_bytes), (ids_b, pair.b_bytes)]
        if any(b"".join(known[i] for i in ids) != whole for ids, known in sides):
            docs.append(None)
            continue
        owner = [[k for k, i in enumerate(ids) for _ in known[i]] for ids, known in sides]
        linked = sorted(set(zip(*owner, strict=True)))
        groups, group = [], ([], [])
        for at in range(len(whole)):
            for side in range(2):
                if at == 0 or owner[side][at] != owner[side][at - 1]:
                    group[side].append(sides[side][0][owner[side][at]])
            if at + 1 == len(whole) or all(o[at + 1] != o[at] for o in owner):
                groups.append(group)
                group = ([], [])
        pairs = [(ids_b[j], ids_a[i]) for i, j in linked]
        counts.update(pairs)
        docs.append((len(ids_a), len(ids_b), groups, pairs))
    highest = defaultdict(int)
    for (b, _), n in counts.items():
        highest[b] = max(highest[b], n)
    for d in docs:
        if d is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in d[2])
            yield d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == highest[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(shown.encode()).hexdigest()


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    if small:
        # Many chunks, levels of merges and pieces.
        for name, value in (("CHUNK_BYTES", 300), ("FAN", 4), ("MERGED", 50), ("PIECE", 7), ("LEAST_RADIX", 5)):
            monkeypatch.setattr(crosstoken, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " ", "  x", "a▁b", texts[0], texts[0], "the " * 2000, "z" * 5000]
    rows = [(None if i % 11 == 5 else i // 2, t, "c", "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, radix string").repartition(3)
    got = Counter(tuple(r) for r in crosstoken.align(df).collect())
    want = Counter((r[0], *w) for r, w in zip(rows, plain(texts), strict=True))
    assert got == want
    pairs = crosstoken.pair_counts(df).collect()
    assert len({(r.b, r.a) for r in pairs}) == len(pairs) and sum(r.n for r in pairs) == sum(k[4] * n for k, n in got.items())


def test_empty(spark):
    assert crosstoken.align(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    (row,) = crosstoken.align(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


def test_every_code_point():
    """Both libraries cut every code point the same way."""
    from tokenizers import Tokenizer

    pair = crosstoken.tokenizers(crosstoken.TOKENIZERS)
    a = Tokenizer.from_file(f"{crosstoken.TOKENIZERS}/byte_bpe_50k.json")
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}" for c in points[lo : lo + 256]) for lo in range(0, len(points), 256)]
    assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [pair.a.encode_ordinary(t) for t in texts]


def test_merge_is_the_sum(monkeypatch):
    monkeypatch.setattr(crosstoken, "MERGED", 40)
    rng = np.random.default_rng(2)
    runs = [np.unique(rng.integers(0, 300, rng.integers(1, 60))) + rng.integers(0, 500) for _ in range(60)]
    runs.sort(key=lambda r: r[0])
    got = list(crosstoken.merged((r, np.arange(len(r)) + 1) for r in runs))
    pairs = np.concatenate([g[0] for g in got])
    want = Counter()
    for r in runs:
        want.update(dict(zip(r.tolist(), (np.arange(len(r)) + 1).tolist(), strict=True)))
    assert (np.diff(pairs) > 0).all() and len(got) > 5
    assert dict(zip(pairs.tolist(), np.concatenate([g[1] for g in got]).tolist(), strict=True)) == dict(want)


def test_runs_round_trip():
    for values in ([], [0], [5, 5, 5], [1 << 40, 3, (1 << 62) + 1]):
        assert crosstoken.unpacked(crosstoken.packed(np.array(values, np.int64))).tolist() == values
    ascending = np.array([3, 9, 1 << 50])
    assert crosstoken.unpacked(crosstoken.packed(ascending, True), True).tolist() == ascending.tolist()


def test_ends_links_and_groups_by_one_pass_over_the_bytes():
    """What ends where, links and groups of random tokens against sets, without a sort of the ends."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        a_ends, b_ends = (np.array(sorted({*rng.integers(1, size + 1, rng.integers(0, size + 1)).tolist(), size})) for _ in range(2))
        ends, kinds = crosstoken.marked(a_ends, b_ends)
        assert ends.tolist() == sorted({*a_ends.tolist(), *b_ends.tolist()})
        assert kinds.tolist() == [(e in a_ends) + 2 * (e in b_ends) for e in ends]
        spans = lambda es: list(zip([0, *es[:-1].tolist()], es.tolist()))
        want = [(i, j) for i, (lo, hi) in enumerate(spans(a_ends)) for j, (left, right) in enumerate(spans(b_ends)) if max(lo, left) < min(hi, right)]
        assert list(zip(*(x.tolist() for x in crosstoken.links(kinds)))) == want
        pair = SimpleNamespace(shown=[f"{i}{sign}" for sign in ",|;" for i in range(50)])
        cut = sorted({*a_ends.tolist()} & {*b_ends.tolist()})
        group = lambda es: [",".join(str(k) for k, e in enumerate(es.tolist()) if lo < e <= hi) for lo, hi in zip([0, *cut[:-1]], cut)]  # noqa: B023, E731
        assert crosstoken.groups_text(pair, np.arange(len(a_ends)), np.arange(len(b_ends)), kinds) == ";".join(f"{x}|{y}" for x, y in zip(group(a_ends), group(b_ends)))
