"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page is cut into text blocks that know their open elements. A linear classifier
gives each block a margin; its positive part is the capacity to the content
terminal, its negative part that to the boilerplate terminal. Smoothness edges
join blocks that follow each other (heavier the more open elements they share)
and blocks of one parent element. The minimum cut (augmenting paths on level
graphs) is the labelling of least total cost.

The classifier is fitted (``fit``) on pages that label themselves: of those with an
article or main element, and no longer than FIT_CHARS, the FIT_PAGES with the smallest
hash of page_id. A block's label is whether it stands in that element, whose tag, class,
id and role are hidden from the signs; a block in it that has a bad sign of its own has
no label. The weights are the most probable ones of a logistic model whose prior are
the weights of PRIOR, each worth PRIOR_ROWS blocks, so that pages which tell little
change little, and without such pages the prior stands. What an article's own tag is
worth can't be learned this way and stays fixed. PRIOR follows from these: without
signs, a block of prose of about 50 characters stands even between content and
boilerplate, which is where one-line remarks end and sentences begin; a sign is worth
more than a long block's length and the edges around it together, so that one long
advert between two paragraphs stays out; everything else is worth less than the edges,
so that short lines inside prose, and prose-like lines inside a menu, go with their
neighbours.

Signs are features, weighed by the nearest element that has any, and undone where an
article stands inside a wrapper whose sign names the page's layout. A name of a class or
id is a full sign if all its words are known ones ("ad-banner", "post-comments"), a
weak one if it has others too ("promo-codes-explained"), and weak ones are all signs
of what holds prose itself, and names like "legal" inside an article. Only what is
never shown as text (scripts, form controls, hidden elements) and navigation is left
out beforehand.

Pages are handled one by one, in whole, without a shuffle; the work grows with a
page's length, however deep its elements are nested.

Defined cases: null or empty html gives an empty text, so does a page without any
block on the content side; unclosed elements end with their parent, a new block
element closes an open paragraph; broken markup is read as text; repeated rows
are answered one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import unescaped
from docstrata.session import table

#: HTML's elements by role.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "select", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul button legend label option".split())
CLOSES_P = BLOCK - frozenset("button label legend option html head body td th tr tbody thead tfoot caption".split())
NEVER = frozenset("nav button menu head option".split())
#: What is left out inside a form only.
CONTROLS = frozenset("label legend".split())
#: Elements that say something by name alone.
SIGNED = NEVER | CONTROLS | frozenset("article main aside footer form dialog fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre figcaption".split())
#: Of these the ones whose own names are weak signs.
QUOTES = PROSE - {"p"} | HEADINGS
CELLS = frozenset("li td th dd dt".split())
#: Roles that are never main text, and roles that are weighed like BAD words.
NEVER_ROLES = frozenset("navigation search menu menubar toolbar".split())
BAD_ROLES = frozenset("banner contentinfo complementary dialog alert alertdialog form note".split())

#: Words of class and id by what they say of an element: never an article's wrapper, a part of the page's layout, main text.
BAD = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions comment comments respond reply replies disqus related recommended recommendations cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pager pagination copyright legal disclaimer".split())
#: Of these the ones that name what an article may hold too.
MILD = frozenset("legal copyright disclaimer related recommended sharing reply".split())
#: Words that say nothing of a part of the page, only of its place or shape.
NEUTRAL = frozenset("box block container wrapper wrap area section list item items inner outer bar panel unit slot top bottom left right center primary secondary site page global link links button buttons title heading label text row col column group module region js id html widget wp form menu the this my new main footer feed media inline large small wide mobile desktop a b c x v".split())
LAYOUT = frozenset("sidebar side aside nav navbar navigation menu footer foot masthead banner widget widgets toolbar notice notices notification notifications alert alerts popup modal dialog overlay search form topbar".split())
GOOD = frozenset("article post story entry content main text body prose".split())
#: A word after or before one of these names a state or a count ("no-sidebar", "comments-open"), not a part of the page.
STATES = frozenset("no has have with without open opened closed enabled disabled count on off".split())

#: What the classifier sees of a block, and the prior of its weights.
FEATURES = ("one", "length", "linked", "heading", "prose", "cell", "legal", "against", "for")
PRIOR = (-0.8, 1.0, -3.0, 1.2, 0.3, -0.4, -2.0, 1.0, 1.0)
PRIOR_ROWS = 1000.0
#: Characters of length that weigh 1, and the most that length weighs.
PER_LENGTH, MOST_LENGTH = 80, 2.0
#: What a link counts less in a paragraph of an article.
LINK_IN_ARTICLE = 0.3
#: Signs: of full and weak names and of tags, of good names and tags, and their bounds.
SIGN, WEAK, TAG_SIGN, GOOD_WORD, GOOD_TAG, LEAST, MOST = -5.0, -0.3, -4.5, 1.0, 1.5, -6.0, 2.5
#: Bounds of the pages that are learned from.
FIT_PAGES, FIT_CHARS = 400, 1 << 18
#: Share of an outer sign that stays with an inner element of the other kind: inside BAD, and an article inside LAYOUT.
KEPT, KEPT_LAYOUT = 0.8, 0.1
#: Edges: between neighbours at least and by shared elements, and to the last block of the same parent.
NEIGHBOUR, SHARED, SIBLING = 0.2, 0.6, 0.4

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[!?][^>]*(?:>|\Z))", re.S)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SIGNS = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
LEGAL = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    depth: int
    number: int
    #: The nearest block element, this one included.
    holder: Element | None = None
    never: bool = False
    #: Sum of the signs of this and the outer elements, and whether the bad part of it names the page's layout only.
    sign: float = 0.0
    layout: bool = False
    in_article: bool = False
    in_form: bool = False


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    linked: int
    kind: str = ""


KNOWN = BAD | LAYOUT | GOOD | NEUTRAL | frozenset(["header"])


@lru_cache(maxsize=1 << 14)
def named(value: str, mild: bool = False) -> tuple[float, bool, bool]:
    """What the names of a class or id value are worth, whether that names the page's layout only, and whether one is good. mild: of what may be in an article."""
    sign, layout, good = 0.0, True, False
    for name in value.split():
        parts = [w.lower() for w in WORDS.findall(name)]
        if not STATES.isdisjoint(parts):
            continue
        is_good = not GOOD.isdisjoint(parts)
        good = good or is_good
        # "entry-header" is an article's head, "post-comments" are comments.
        bad = {w for w in parts if w in BAD or w == "header" and not is_good}
        if bad or not LAYOUT.isdisjoint(parts):
            full = KNOWN.issuperset(parts) and not (mild and bad and bad <= MILD)
            sign = min(sign, SIGN if full else WEAK)
            layout = layout and not bad
    return sign, layout and sign < 0, good


def _open(name: str, attributes: str, parent: Element, number: int, hide: bool) -> Element:
    if name not in SIGNED and not attributes:
        made = Element(name, parent, parent.depth + 1, number, parent.holder, parent.never, parent.sign, parent.layout, parent.in_article, parent.in_form)
        if name in BLOCK:
            made.holder = made
        return made
    made = Element(name, parent, parent.depth + 1, number)
    made.holder = made if name in BLOCK else parent.holder
    made.in_form = parent.in_form or name == "form" or name == "fieldset"
    made.never = parent.never or name in NEVER or name in CONTROLS and made.in_form
    article = name in ("article", "main") or bool(attributes) and any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ("article", "main") for m in SIGNS.finditer(attributes))
    made.in_article = parent.in_article or article
    if article and hide:
        made.sign, made.layout = parent.sign, parent.layout
        return made
    own, layout = 0.0, True
    if name == "aside" or name == "footer":
        own, layout = TAG_SIGN, False
    elif name == "form" or name == "dialog" or name == "fieldset" or name == "header" and not parent.in_article:
        own = TAG_SIGN
    good = GOOD_TAG if article else 0.0
    for m in SIGNS.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            made.never = True
        elif key == "role":
            role = value.lower()
            made.never = made.never or role in NEVER_ROLES
            if role in BAD_ROLES:
                own = min(own, SIGN)
        elif key in ("class", "id") and name not in ("html", "body"):
            sign, is_layout, is_good = named(value, parent.in_article or article)
            if sign and (name in QUOTES or article):
                sign = WEAK
            if sign:
                own, layout = min(own, sign), layout and is_layout
            good = max(good, GOOD_WORD if is_good else 0.0)
    if own < WEAK:
        made.sign, made.layout = max(LEAST, own + min(0.0, parent.sign)), layout and (parent.layout or parent.sign >= 0)
    elif good or own:
        kept = parent.sign if parent.sign >= 0 or not article and (parent.layout or not good) else parent.sign * (KEPT_LAYOUT if parent.layout else KEPT)
        made.sign, made.layout = max(LEAST, min(MOST, kept + good + own)), parent.layout
    else:
        made.sign, made.layout = parent.sign, parent.layout
    return made


class Stack:
    """The open elements, with the places of each name and of all block elements, so that no tag looks through them."""

    def __init__(self, hide: bool = False) -> None:
        self.hide = hide
        root = Element("#root", None, 0, 0)
        root.holder = root
        self.open = [root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.count = 0

    def last(self, *names: str) -> int:
        """Place of the innermost open element of the names, 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def push(self, name: str, attributes: str) -> None:
        self.count += 1
        place = len(self.open)
        self.open.append(_open(name, attributes, self.open[-1], self.count, self.hide))
        self.at[name].append(place)
        if name in BLOCK:
            self.blocks.append(place)

    def close(self, to: int) -> None:
        while len(self.open) > to:
            name = self.open.pop().name
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()


#: An element that an open one of the same kind ends at, and what holds such elements.
ITEMS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


def blocks(page: str, hide: bool = False) -> list[Block]:
    """The text blocks of a page in order, with white space reduced and references decoded; hide: without the signs of articles' own elements."""
    stack, out, parts, links = Stack(hide), [], [], 0

    def flush() -> None:
        nonlocal links
        text = "".join(parts)
        if text and not text.isspace():
            text = SPACE.sub(" ", unescaped(text) if "&" in text else text).strip()
            if text:
                holder = stack.open[-1].holder
                out.append(Block(text, holder, min(links, len(text)), holder.name))
        parts.clear()
        links = 0

    at, size = 0, len(page)
    find = TAG.search
    while at < size:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if stack.at.get("a"):
                links += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            k = stack.last(name)
            # An inline end tag does not reach out of its block.
            if k and (name in BLOCK or not stack.blocks or stack.blocks[-1] < k):
                stack.close(k)
            continue
        if name in RAW_END:
            # What the element holds is no markup and no main text.
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and (k := stack.last("p")):
                stack.close(k)
            if name in ITEMS:
                same, around = ITEMS[name]
                k = stack.last(*same)
                if k and k > stack.last(*around):
                    stack.close(k)
        stack.push(name, m[3])
    flush()
    return out


def seen(block: Block) -> tuple[float, ...]:
    """The block's FEATURES."""
    length, sign = len(block.text), block.element.sign
    linked = block.linked / max(1, length) * (LINK_IN_ARTICLE if block.element.in_article and block.kind == "p" else 1.0)
    heading, prose, cell = block.kind in HEADINGS, block.kind in PROSE, block.kind in CELLS
    return 1.0, min(MOST_LENGTH, length / PER_LENGTH), linked, float(heading), float(prose), float(cell), float(sign <= 0 and bool(LEGAL.match(block.text))), min(0.0, sign), max(0.0, sign)


def margin(block: Block, weights: Sequence[float] = PRIOR) -> float:
    """How much rather content than boilerplate a block is by itself."""
    return sum(w * f for w, f in zip(weights, seen(block), strict=True))


def costs(block: Block, weights: Sequence[float] = PRIOR) -> tuple[float, float]:
    """Costs of labelling the block as content and as boilerplate."""
    by = margin(block, weights)
    return max(0.0, -by), max(0.0, by)


def most_probable(x: np.ndarray, y: np.ndarray, steps: int = 20) -> list[float]:
    """Newton's method on the logistic loss; a weight's distance to its prior costs like PRIOR_ROWS rows."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + PRIOR_ROWS * (w - prior)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w)), slope)
    return w.tolist()


def self_labelled(page: str) -> list[tuple[tuple[float, ...], float]]:
    """Features and label of the blocks of a page, its articles' elements hidden; what is in an article by its place but not by its signs has no label."""
    out = []
    for b in blocks(page, hide=True):
        if not b.element.never and not (b.element.in_article and b.element.sign < 0):
            out.append((seen(b), float(b.element.in_article)))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row for page in batch.column(0).to_pylist() for row in self_labelled(page)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64())], ["x", "y"])


def fit(pages: DataFrame, most: int = FIT_PAGES) -> list[float]:
    """The classifier's weights."""
    html = F.col("html").cast("string")
    known = pages.select("page_id", html.alias("html")).where(F.length("html") <= FIT_CHARS).where(F.col("html").rlike(r"(?i)<(?:article|main)\b"))
    # Ids first, so that no page is sorted but the chosen ones.
    chosen = known.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(most).distinct()
    sample = known.join(F.broadcast(chosen), "page_id", "left_semi").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html"), "html").limit(most).select("html")
    rows = sample.mapInArrow(_labelled, "x array<double>, y double").collect()
    rows = sorted((r["x"], r["y"]) for r in rows)
    return most_probable(np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows]))


def smoothness(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Edges between neighbours, by shared elements, and to the last block before of the same parent element."""
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.element.parent or b.element
        if i:
            a, c = found[i - 1].element, b.element
            depth = max(a.depth, c.depth, 1)
            # The way from one block to the next passes only elements whose tags stand between them.
            while a is not c:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
            yield i - 1, i, NEIGHBOUR + SHARED * a.depth / depth
        j = last.get(parent.number)
        if j is not None:
            yield j, i, SIBLING
        last[parent.number] = i


def minimum_cut(n: int, terminal: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut (Dinic's algorithm; ties go to boilerplate)."""
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def arc(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(forth)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, (as_content, as_boiler) in enumerate(terminal):
        # The direct path source - node - sink carries the smaller of both costs in any case.
        through = min(as_content, as_boiler)
        if as_boiler > through:
            arc(source, i, as_boiler - through, 0.0)
        if as_content > through:
            arc(i, sink, as_content - through, 0.0)
    for i, j, w in edges:
        if w > 0:
            arc(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for k in head[u]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            break
        place = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                first = next(i for i, k in enumerate(path) if cap[k] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
            arcs = head[u]
            while place[u] < len(arcs):
                k = arcs[place[u]]
                if cap[k] > tiny and level[to[k]] == level[u] + 1:
                    path.append(k)
                    u = to[k]
                    break
                place[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
    # The smallest source side: what the source still reaches.
    return [level[i] >= 0 for i in range(n)]


def extract(page: str | None, weights: Sequence[float] = PRIOR) -> str:
    if not page:
        return ""
    found = [b for b in blocks(page) if not b.element.never]
    keep = minimum_cut(len(found), [costs(b, weights) for b in found], list(smoothness(found)))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _pages(weights: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, weights: Sequence[float] = PRIOR) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_pages(weights), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages))
