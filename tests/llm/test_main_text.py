"""Main text: whole pages against a brute-force cut, pages on which the cut decides, wrappers, deep nesting."""

import itertools
import math
import random
import time

import pytest

from docstrata.llm import htmlmain

PROSE = "This is a fairly long paragraph of an article, which has enough words to stand by itself."
LINE = "Rain."
MENU = '<li><a href="/x">Somewhere</a></li>'


def labelled(page):
    found = [b for b in htmlmain.blocks(page) if not b.element.never]
    terminal, edges = [htmlmain.costs(b) for b in found], list(htmlmain.smoothness(found))
    return found, terminal, edges


def cost(keep, terminal, edges):
    return sum(a if k else b for k, (a, b) in zip(keep, terminal, strict=True)) + sum(w for i, j, w in edges if keep[i] != keep[j])


def test_whole_pages_against_every_labelling():
    rng = random.Random(3)
    pieces = [f"<p>{PROSE}</p>", f"<p>{LINE}</p>", MENU, "<h2>Head</h2>", f'<div class="ad">{PROSE}</div>', "<div>", "</div>", f'<div class="story"><p>{LINE}</p>', "<td>4</td>", "plain words"]
    for _ in range(60):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        found, terminal, edges = labelled(page)
        best = min((cost(k, terminal, edges) for k in itertools.product((False, True), repeat=len(found))), default=0.0)
        keep = htmlmain.minimum_cut(len(found), terminal, edges)
        assert math.isclose(cost(keep, terminal, edges), best, abs_tol=1e-9)
        assert htmlmain.extract(page) == "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # A short line between paragraphs of one element is content, though by itself it is not.
        (f"<div><p>{PROSE}</p><p>{LINE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{LINE}\n{PROSE}"),
        # A title-like line in a list of links is not, though by itself it is.
        (f"<div><ul>{MENU * 3}</ul><h3>Go</h3><ul>{MENU * 3}</ul></div><div><p>{PROSE}</p></div>", PROSE),
    ],
)
def test_cut_and_threshold_differ(page, want):
    found, terminal, edges = labelled(page)
    by_margin = "\n".join(b.text for b in found if htmlmain.margin(b) > 0)
    assert by_margin != want and htmlmain.extract(page) == want


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="no-sidebar"><article><p>{PROSE}</p></article></div>',
        f'<article class="post comments-open"><p>{PROSE}</p></article>',
        f'<form id="aspnetForm"><article><p>{PROSE}</p></article></form>',
        f'<div id="layout" class="layout sidebar-right"><main><p>{PROSE}</p></main></div>',
        f'<article><p>{PROSE}</p></article><div id="comments"><article><p>{PROSE}</p></article><div><div><p>{PROSE}</p></div></div></div>',
        f"<article><p>{PROSE}</p></article><aside><p>{PROSE}</p></aside><footer><p>{PROSE}</p></footer>",
        f'<header><h1>Site</h1></header><div class="cookie-notice"><p>{PROSE}</p></div><article><p>{PROSE}</p><form><label>Name</label><p>{PROSE}</p><button>Go</button></form></article>',
        f'<article><p>{PROSE}</p><div hidden><p>{PROSE}</p></div><div style="display: none"><p>{PROSE}</p></div><div role="search">{PROSE}</div></article>',
    ],
)
def test_wrappers_and_signs(page):
    assert htmlmain.extract(page) == PROSE


SENTENCE = "This is one ordinary sentence of prose, of the kind that people write."


@pytest.mark.parametrize("weights", [htmlmain.PRIOR, (0.6, 1.7, -3.0, 1.4, 1.5, -0.4, -2.0, 1.3, 1.0)])
@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article class="story ad-free"><p>{SENTENCE}</p></article>', SENTENCE),
        (f'<section id="promo-codes-explained"><p>{SENTENCE}</p></section>', SENTENCE),
        (f'<div class="search-results-article"><p>{SENTENCE}</p></div>', SENTENCE),
        (f'<article><p>{SENTENCE}</p><section class="share-price"><p>{SENTENCE}</p></section><blockquote class="legal">{SENTENCE}</blockquote><label>Note</label><p><a href="x">{SENTENCE}</a></p></article>', "\n".join([SENTENCE, SENTENCE, SENTENCE, "Note", SENTENCE])),
        (f'<article><p>{SENTENCE}</p><div class="ad-banner"><p>{SENTENCE}</p></div><div class="post-comments"><p>{SENTENCE}</p></div><form><label>Name</label></form></article>', SENTENCE),
    ],
)
def test_names_by_whole_words(page, want, weights):
    assert htmlmain.extract(page, weights) == want


def test_fit_learns_from_hidden_articles(spark):
    import pyarrow.parquet as pq

    html = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    teaching, rest = html[:100], html[100:]
    rows = [(i, h, "c") for i, h in enumerate(teaching)] + [(None, teaching[0], ""), (5, None, ""), (1000, "<p>no article", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, x string").repartition(3)
    weights = htmlmain.fit(pages)
    assert weights == htmlmain.fit(pages.repartition(5)) and len(weights) == len(htmlmain.FEATURES)
    labelled = [r for page in rest for r in htmlmain.self_labelled(page)]
    right = sum((sum(w * f for w, f in zip(weights, x, strict=True)) > 0) == (y > 0) for x, y in labelled)
    assert right / len(labelled) > 0.98
    # Nothing to learn from: the prior.
    assert htmlmain.fit(pages.where("page_id = 1000")) == list(htmlmain.PRIOR) and htmlmain.fit(pages.limit(0)) == list(htmlmain.PRIOR)


def test_hidden_elements_leave_no_sign():
    page = f'<div><article class="post ad"><p>{PROSE}</p></article><div role="main" id="content"><p>{PROSE}</p></div></div>'
    (first, label), (second, other) = htmlmain.self_labelled(page)
    assert first == second and first[-2:] == (0.0, 0.0) and label == other == 1.0


def test_blocks_against_another_parser():
    """All text that blocks give is what the standard library's parser sees outside raw elements, in order, without white space."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.raw, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in htmlmain.RAW

        def handle_endtag(self, tag):
            self.raw -= tag in htmlmain.RAW and self.raw > 0

        def handle_data(self, data):
            if not self.raw:
                self.parts.append(data)

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        parser = Text()
        parser.feed(page)
        parser.close()
        assert "".join("".join(b.text for b in htmlmain.blocks(page)).split()) == "".join("".join(parser.parts).split())


def test_references_of_any_length():
    page = f"<p>&#{'0' * 5000}65; &#{'1' * 5000}; &#x{'0' * 5000}42; {PROSE}</p>"
    assert htmlmain.extract(page) == f"A \ufffd B {PROSE}"


def test_deep_nesting_is_linear():
    for page in (*(x * 200_000 for x in ("<!", "<?", "<a ", "<a '", '<a "', "</", "<title", "<p x=", "&", "<p>")), "<div>" * 200_000 + PROSE, "<div>x" * 200_000, "<b>" * 200_000 + "<li>x" * 200_000, "<p><a>" * 100_000 + "</i></p>" * 100_000):
        began = time.time()
        htmlmain.extract(page)
        assert time.time() - began < 20


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, n_chars int")
    assert htmlmain.extract_pages(empty).count() == 0 and htmlmain.extract_pages(empty).columns == ["page_id", "url", "text", "n_chars"]
