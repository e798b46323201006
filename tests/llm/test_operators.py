"""The operators against plain versions on a small fixture with hard rows."""

import gzip
import hashlib
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docstrata.llm import components, decontam, htmlmain, langid, license, mixing, ordermin, pii, simhash, toxicity, warc

WORDS = "alpha beta gamma delta été straße niño über key lock stone river cloud tree house light".split()
ODD = [
    None,
    "",
    " \t\n",
    "one",
    "One TWO",
    "Released under the MIT License. under the mit license",
    "cc by nc cc by nc",
    "Apache License, Version 2.0 and CC-BY-NC",
    "mail a@b.co, c+d@e.f.g! 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 +1 (366) 555-9807",
    "x@y z@w. 4111111111111112 +1 2 IBAN GB82 WEST 1234 5698 7654 32",
    "a@b.c+d@e.f 1.2.3.4.5.6.7.8 ssn 123-45-6789 123-45-6789",
    "same same same same same same same",
    "idiot you idiot",
    "é\U0001f600 中文" * 3,
]


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    texts = list(ODD)
    while len(texts) < n:
        kind = rng.random()
        base = rng.choice(texts) if kind < 0.4 else None
        if base and len(base) > 40:
            texts.append(base if kind < 0.2 else base.replace(rng.choice(WORDS), rng.choice(WORDS), 1))
        else:
            texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice((3, 8, 40, 200)))))
    texts.append(" ".join(rng.choice(WORDS) for _ in range(20_000)))
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "extra") for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + [rows[20]], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# 7: decontamination


def plain_hits(text, items, window=10):
    ws = split(text)
    hit, found = set(), set()
    for name, t in items:
        iw = split(t)
        for k in range(max(1, len(iw) - window + 1)) if iw else ():
            part = iw[k : k + window]
            for i in range(len(ws) - len(part) + 1):
                if ws[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(name)
    return len(ws), len(hit), sorted(found)


def items(rows):
    long = rows[-1][1].split()
    return [("7", " ".join(long[100:130])), ("10", "One-two"), ("9", None), (None, "x"), ("8", ""), ("11", "under THE mit license"), ("11", "same same"), ("12", " ".join(long[500:512]) + " zebra")]


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    bench = items(rows)
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontam.matches(docs, spark.createDataFrame(bench, "item_id string, text string")).collect()}
    known = [(a, b) for a, b in bench if a is not None]
    assert got == {r[0]: plain_hits(r[1], known) for r in rows}
    kept = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id string, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in [*rows, rows[20]] if not plain_hits(r[1], known)[1])


def test_decontamination_near_and_empty(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a x b c d y e f g h i j"), (2, "a b c")], "doc_id bigint, text string")
    got = {r.doc_id: (r["items"], r.near) for r in decontam.matches(one, bench).collect()}
    assert got == {1: ([], ["1"]), 2: ([], [])}
    assert decontam.matches(none, bench).count() == 0
    assert decontam.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# 10: personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, tmp_path, docs, rows, none):
    d = save(spark, tmp_path, documents=docs)
    got = {r.doc_id: r for r in pii.query(spark, d).collect()}
    for r in rows:
        base = plain_pii(r[1])
        g = got[r[0]]
        assert [g[f"n_{k}"] for k in PLAIN] == [sum(b.startswith(k) for b in base) for k in PLAIN]
        assert g.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(g.spans.split(",")) | {""}
    assert "iban" in got[9].spans
    assert got[10].spans.count("ssn") == 2 or got[10].spans.count("ssn") == 1
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert clean[0].text is None and clean[3].text == "one"
    assert clean[8].text == "mail [EMAIL], [EMAIL]! [IP] 999.1.1.1 card [CARD] [PHONE]"
    assert clean[8].n_chars == len(clean[8].text)
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0


def test_pii_long_runs_end(spark):
    long = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "1 " * 100_000, "+" + "1(" * 50_000, "a@" * 50_000, ("a@b.c " * 20_000)]
    got = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id bigint, text string")).selectExpr("doc_id", "size(spans) n").collect()
    assert {r.doc_id: r.n for r in got}[6] == 20_000


# 3: near-duplicates


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(prints, most=3):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_simhash(spark, tmp_path, docs, rows, none):
    d = save(spark, tmp_path, documents=docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, d).collect()}
    prints = {r[0]: plain_simhash(r[1]) for r in rows}
    groups = plain_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted({*groups.values()})
    assert simhash.groups(none).count() == 0 and simhash.deduplicate(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (6, "q"), (6, "z y x w v"), (7, "z y x w v"), (None, "lonely one here")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups(odd).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5), (6, 6), (6, 6), (7, 6)]


def test_anchors_cover_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    near = [int(b) for b in base]
    for b in base:
        x = int(b)
        for k in rng.choice(63, 3, replace=False):
            x ^= 1 << int(k)
        near.append(x)
    reps = spark.createDataFrame([(i, f) for i, f in enumerate(near)], "node bigint, fp bigint")
    found = {r.node: r.component for r in components.components(simhash.links(reps)).collect()}
    assert found == {**{i: i for i in range(40)}, **{40 + i: i for i in range(40)}}


def test_links_count_bit_63(spark):
    rng = np.random.default_rng(4)
    base = [int(b) for b in rng.integers(0, 1 << 64, 60, dtype=np.uint64)]
    near = [b ^ sum(1 << int(k) for k in {63, *rng.choice(64, 2, replace=False).tolist()}) for b in base]
    reps = spark.createDataFrame([(i, _signed(f)) for i, f in enumerate(base + near)], "node bigint, fp bigint")
    found = {r.node: r.component for r in components.components(simhash.links(reps)).collect()}
    assert found == {i: i % 60 for i in range(120)}


def test_forest_counts_bit_63():
    prints = [0, *(1 << 63 | 1 << i for i in range(40))]
    columns = [*([[0] * 41] * 3), list(range(41)), [_signed(f) for f in prints]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "lo", "hi", "node", "fp"])
    (out,) = simhash._compare(2)(iter([batch]))
    assert {(r["a"], r["b"]) for r in out.to_pylist()} == {(0, i) for i in range(1, 41)}


@pytest.mark.parametrize("hot", [20_000, 50])
def test_one_hot_anchor(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    prints = {i: f for i, f in enumerate(sorted({sum(1 << b for b in c) for c in [(i, j) for i in range(30) for j in range(30)]}))}
    found = components.components(simhash.links(spark.createDataFrame(list(prints.items()), "node bigint, fp bigint"))).collect()
    assert {r.component for r in found} == {0} and len(found) == len(prints)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.components(links.limit(0)).count() == 0


# 1: order minhash


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chain(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return _signed(h)


def plain_order_minhash(text):
    t = re.findall(ordermin.TOKENS, text)
    seen, out = {}, []
    for i in range(len(t)):
        k = _chain(w.encode() for w in t[i : i + 3]) >> 24
        n = seen.get(k, 0)
        out.append((_chain((struct.pack("<q", k), struct.pack("<i", n - 1))) >> 24 if n else k, i))
        seen[k] = n + 1
    bins = {}
    for h, i in sorted(out):
        bins.setdefault(h >> 34, []).append((h, i))
    return [(b + 32) * 65536 + (_chain(struct.pack("<q", h) for h, _ in sorted(e[:2], key=lambda x: x[1])) & 65535) for b, e in sorted(bins.items())]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    p = len({*a} & {*b}) / len({x >> 16 for x in [*a, *b]})
    return 2 * math.sqrt(p) / (1 + math.sqrt(p))


@pytest.mark.parametrize("take", [0, 1, 2, None])
def test_order_minhash(spark, tmp_path, rows, take):
    some = rows[8 : 8 + take] if take is not None else rows
    d = save(spark, tmp_path, documents=spark.createDataFrame(some, SCHEMA).repartition(3))
    got = {r.doc_id: r for r in ordermin.query(spark, d).collect()}
    order = sorted(some, key=lambda r: -r[0])
    assert len(got) == len(some)
    for r, after in zip(order, [*order[1:], *order[:1]], strict=True):
        text, other = r[1] or "", after[1] or ""
        edit = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = map(plain_order_minhash, (text, edit, other))
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert g.fingerprint == "".join(f"{x:06x}" for x in a) and g.edited_fingerprint == "".join(f"{x:06x}" for x in b)
        assert math.isclose(g.near_edited, plain_likeness(a, b)) and math.isclose(g.near_next, plain_likeness(a, c))


# 4: licences


def test_license_scan(docs, rows, none):
    phrases = [(p.split(), label) for p, label in license.BASE]
    got = {r.doc_id: r for r in license.scan(docs).collect()}
    for r in rows:
        ws = split(r[1])
        places = [(i, label) for p, label in phrases for i in range(len(ws)) if ws[i : i + len(p)] == p]
        g = got[r[0]]
        starts = [i for i, _ in places]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(ws), len(places), min(starts, default=None), max(starts, default=None))
        assert g.base_labels == ",".join(sorted({label for _, label in places}))
        assert {*g.base_labels.split(",")} - {""} <= {*g.labels.split(",")} and 0 <= g.score <= 1
    assert license.scan(none).count() == 0


def test_automaton_statistics():
    rng = random.Random(1)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(30)] for _ in range(4)]
    automaton = license.Automaton(sequences)
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(400)]
    known = {tuple(s[i:j]) for s in sequences for i in range(30) for j in range(i + 1, 31)}
    expected = []
    for i in range(len(text)):
        n = next((n for n in range(min(30, i + 1), 0, -1) if tuple(text[i - n + 1 : i + 1]) in known), 0)
        if n:
            expected.append((i, n))
    assert [(a, n) for a, n, _ in automaton.statistics(text, 1)] == expected


def test_license_template_with_gap():
    scanner = license.Scanner()
    words = "before this program is free software you can ADDED redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license".lower().encode().split()
    places, spans, score = scanner.scan(words)
    assert not places and "gpl-3" in {scanner.labels[s[2]] for s in spans} and score > 0.9


# 6: languages


def test_language_id(spark, none):
    rng = random.Random(2)
    tongues = {"en": "the and thing ther with ould ness".split(), "de": "der die schön keit über und ung".split()}
    rows = [(i, " ".join(rng.choice(tongues[lang]) + rng.choice(tongues[lang]) for _ in range(30)), lang) for i in range(300) for lang in ["en" if i % 2 else "de"]]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "der die und", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


# 8: toxicity


def test_toxicity(spark, none):
    rng = random.Random(4)
    insult = ["vilecreature", "badfool"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        ws = [rng.choice(WORDS) for _ in range(30)]
        if toxic:
            for k in rng.sample(range(30), 2):
                ws[k] = rng.choice(insult)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you b@df00l and v.i.l.ecreature")]
    labels += [(2000, 0, 1), (1, 0, None), (None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {b"vilecreature", b"badfool"} <= set(model.lexicon)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= toxicity.REJECT) == (i % 5 == 0) for i in range(600))
    assert all(0 <= s <= 1 for s in got.values())
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).collect())[:4] == [1, 2, 3, 4]
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).where("score > 0").count() == 0
    assert toxicity.score(none, model).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    raw = rng.random(500)
    knots, share = toxicity.isotonic(raw, (rng.random(500) < raw).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(share) >= 0).all() and share.min() >= 0 and share.max() <= 1


# 9: main text


def test_html_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site top</p></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this thing now, it is very good indeed.</div>
    <article><h1>Head &amp; more</h1><p>First   paragraph<br>with <b>bold</b> text.<p>Second &#233; one.<script>var a="<p>x</p>"</script></article>
    <div id="comments"><p>I like this article very much indeed.</p></div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""
    assert htmlmain.extract(page) == "Head & more\nFirst paragraph with bold text.\nSecond é one."
    assert htmlmain.extract(None) == "" and htmlmain.extract("") == "" and htmlmain.extract("<nav>a</nav>") == ""
    assert htmlmain.extract('<p title="a>b">A long enough paragraph of text to be kept') == "A long enough paragraph of text to be kept"
    assert htmlmain.extract("<" * 50_000 + '"' * 50_000) is not None
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (1, "u", page, "x")]
    got = htmlmain.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


def test_minimum_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randint(1, 8)
        terminal = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep):
            return sum(a if k else b for k, (a, b) in zip(keep, terminal, strict=True)) + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(htmlmain.minimum_cut(n, terminal, edges)), best, abs_tol=1e-6)


# 2: WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>A &amp; B</title><p>One<p>two<script>x</script>", 3), (2, None, None, 4), (3, "u", "é" * 10, 5)], "page_id bigint, url string, html string, block int")
    made = warc.derive(warc.responses(pages))
    rows = sorted(made.collect(), key=lambda r: (r.page_id, r.record_type))
    assert len(rows) == 6 and rows[0].block == "A & B\nOne\ntwo" and rows[0].record_type == "conversion"
    assert all(r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode()) for r in rows)
    assert rows[0].refers_to == rows[1].refers_to and "source-header: HTTP/1.1 200 OK" in rows[1].block
    data = b"".join(bytes(r.member) for r in warc.gzip_members(made).collect())
    back = {f["warc-record-id"]: (f, b) for f, b in warc.parse_records(data)}
    assert {r.record_id: r.block.encode() for r in rows} == {k: b for k, (_, b) in back.items()}
    assert all(back[r.record_id][0]["warc-refers-to"] == r.refers_to for r in rows)
    head = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = b"<p>Hi</p>"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://b/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(head + body) + head + body + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(read) == 2 and bytes(read[0].payload) == b"<p>Hi</p>" and read[0].http_headers.endswith("Server: x")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# 5: mixing


def plain_water(budget, children):
    """{name: (weight, supply)} -> whole shares by filling up."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, s) in open_.items() if s * total <= budget * w]
        if not full:
            return got | {k: budget * w // total for k, (w, s) in open_.items()}
        k = min(full, key=lambda k: open_[k][1] / open_[k][0])
        got[k] = open_[k][1]
        budget -= open_[k][1]
        del open_[k]
    return got


def test_mixing_budgets(spark):
    leaves = {("d0", "en", "a"): 100, ("d0", "en", "b"): 1000, ("d0", "de", "c"): 10, ("d1", "en", "d"): 50, ("d3", "xx", "e"): 5000}
    got = {(r.domain, r.lang, r.source): r.got for r in mixing.budgets(spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens bigint")).collect()}
    total = math.floor(sum(leaves.values()) * mixing.BUDGET)
    supply = lambda *p: sum(2 * v for k, v in leaves.items() if k[: len(p)] == p)
    top = plain_water(total, {d: (mixing.DOMAIN_WEIGHTS[d], supply(d)) for d in ("d0", "d1", "d3")})
    for d, have in top.items():
        mid = plain_water(have, {lang: (mixing.LANG_WEIGHTS.get(lang, 1), supply(d, lang)) for lang in {k[1] for k in leaves if k[0] == d}})
        for lang, part in mid.items():
            low = plain_water(part, {s: (1, supply(d, lang, s)) for _, _, s in [k for k in leaves if k[:2] == (d, lang)]})
            assert {k[2]: v for k, v in got.items() if k[:2] == (d, lang)} == low


def test_mixing_prefixes(spark, docs, none):
    chosen = mixing.select(docs).collect()
    have = {(r.domain, r.lang, r.source): r.got for r in mixing.budgets(mixing.keyed(docs).groupBy("domain", "lang", "source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")).collect()}
    for leaf, got in have.items():
        taken = [r for r in chosen if (r.domain, r.lang, r.source) == leaf]
        total = sum(r.tokens * r.copies for r in taken)
        assert total >= got and total - got < max([r.tokens for r in taken], default=1)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert mixing.select(none).count() == 0 and mixing.mix(none).count() == 0


def test_clashing_columns(spark):
    odd = "doc_id bigint, text string, lang string, source string, copies int, _key string, _spans string, fp int, spans string, n int, component_id int, tokens int"
    docs = spark.createDataFrame([(i, "a b c " * 5 + str(i % 3), "en", "s", 9, "k", "s", 1, "p", 2, 3, 4) for i in range(6)], odd)
    assert mixing.mix(docs).columns[-1] == "copies" and sorted(mixing.mix(docs).columns) == sorted(docs.columns)
    assert pii.redact(docs).count() == 6 and pii.redact(docs).columns == docs.columns
    assert simhash.deduplicate(docs).columns == docs.columns and 1 <= simhash.deduplicate(docs).count() <= 3
    assert toxicity.keep_clean(docs, toxicity.Model()).columns == docs.columns
    assert decontam.decontaminate(docs, spark.createDataFrame([(1, "x y")], "item_id int, text string")).columns == docs.columns
