"""The positioned page layer: shapes, images, text and links of a page as absolutely placed HTML, in paint order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is painted first.
PAINT = {"shape": 0, "path": 1, "image": 2, "text": 3, "link": 4}


def points(x: Column) -> Column:
    """A length with two decimals, halves to even."""
    return F.concat(F.format_string("%.2f", F.bround(x, 2)), F.lit("pt"))


def _escaped(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _box(*more: Column) -> Column:
    return F.concat(F.lit("position:absolute;left:"), points(F.col("x")), F.lit(";top:"), points(F.col("top")), *more)


def element_html() -> Column:
    """HTML of one element row (kind, x, top, width, height, text, fill, stroke, turn, href)."""
    size = [F.lit(";width:"), points(F.col("width")), F.lit(";height:"), points(F.col("height"))]
    colour = lambda name, c: F.coalesce(F.concat(F.lit(f";{name}:"), F.col(c)), F.lit(""))
    turn = F.when(F.abs("turn") >= 0.5, F.concat(F.lit(";transform:rotate("), F.format_string("%.2f", -F.col("turn")), F.lit("deg)"))).otherwise("")
    text = F.concat(F.lit('<span style="'), _box(F.lit(";font-size:"), points(F.col("height")), colour("color", "fill"), turn), F.lit('">'), _escaped(F.col("text")), F.lit("</span>"))
    shape = F.concat(F.lit('<div style="'), _box(*size, colour("background", "fill"), F.coalesce(F.concat(F.lit(";border:0.75pt solid "), F.col("stroke")), F.lit(""))), F.lit('"></div>'))
    image = F.concat(F.lit('<img src="'), _escaped(F.coalesce("href", F.lit(""))), F.lit('" style="'), _box(*size), F.lit('">'))
    link = F.concat(F.lit('<a href="'), _escaped(F.coalesce("href", F.lit(""))), F.lit('" style="'), _box(*size), F.lit('"></a>'))
    path = F.concat(F.lit('<svg style="'), _box(*size), F.lit('"><path d="'), _escaped(F.coalesce("text", F.lit(""))), F.lit('" fill="'), F.coalesce("fill", F.lit("none")), F.lit('" stroke="'), F.coalesce("stroke", F.lit("none")), F.lit('"/></svg>'))
    return F.when(F.col("kind") == "text", text).when(F.col("kind") == "image", image).when(F.col("kind") == "link", link).when(F.col("kind") == "path", path).otherwise(shape)


def render_pages(elements: DataFrame) -> DataFrame:
    """elements (doc_id, page, seq, kind, x, y, width, height, text, fill, stroke, turn, href, page_width, page_height) to one HTML section a page.

    y is the lower edge from the page's foot, or the baseline for text. Backgrounds that fill the page stay, what lies outside it goes.
    """
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in PAINT.items()), F.lit(0))
    placed = elements.withColumn("top", F.col("page_height") - F.col("y") - F.col("height"))
    placed = placed.where("x + width > 0 and x < page_width and top + height > 0 and top < page_height")
    rows = placed.select("doc_id", "page", "page_width", "page_height", F.struct(rank.alias("rank"), "seq", element_html().alias("html")).alias("e"))
    made = rows.groupBy("doc_id", "page").agg(F.max("page_width").alias("w"), F.max("page_height").alias("h"), F.array_sort(F.collect_list("e")).alias("es"))
    html = F.concat(F.lit('<section class="page" style="position:relative;width:'), points(F.col("w")), F.lit(";height:"), points(F.col("h")), F.lit('">'), F.array_join(F.transform("es", lambda e: e["html"]), ""), F.lit("</section>"))
    return made.select("doc_id", "page", html.alias("html"))
