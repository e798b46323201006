"""What lies near what on a page: band joins by grid cells, links laid on segments, sum signs of formulas.

A band join asks for ``low <= right - left <= high`` in one or two coordinates. Each side
gets the grid cells it can meet the other in, three at most in a coordinate, so that the
join is one on equal keys, and no pair of a page's rows is made but near ones. Bounds are
constants; what depends on a row (a font size, another row's place) is asked of the
pairs that are left.

Defined cases: rows with a null page or place meet nothing and stay as they are; equal
rows are told apart by their numbers; of several partners the first by number wins;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest font size that a page shows, by which the bands of links and markers are bounded.
LARGEST_FONT = 48.0
PAGE_HEIGHT = 792.0
#: Share of a cell by which a row near its border counts for both cells.
HAIR = 1e-6


def cells(at: Column, low: float, high: float) -> Column:
    """The grid cells, of the band's own width, between ``at + low`` and ``at + high``, and a hair beyond, since sums are rounded."""
    size = max(high - low, 1e-6)
    return F.sequence(F.floor((at + low) / size - HAIR), F.floor((at + high) / size + HAIR))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], bands: dict[str, tuple[str, float, float]], how: str = "inner") -> DataFrame:
    """Pairs of equal keys with ``low <= right[b] - left[a] <= high`` for each ``a: (b, low, high)``; columns must differ but for the keys.

    Bounds are met up to a HAIR, as differences of doubles are rounded; who needs them sharp asks again.
    For ``left_semi`` and ``left_anti`` the right side is spread over the cells instead, so that a left row stays one row.
    """
    made, within = [], F.lit(True)
    spread_left = how == "inner"
    for k, (a, (b, low, high)) in enumerate(bands.items()):
        name, size = f"__cell{k}", max(high - low, 1e-6)
        if spread_left:
            left = left.withColumn(name, F.explode(cells(F.col(a), low, high)))
            right = right.withColumn(name, F.floor(F.col(b) / size))
        else:
            left = left.withColumn(name, F.floor(F.col(a) / size))
            right = right.withColumn(name, F.explode(cells(F.col(b), -high, -low)))
        made.append(name)
        within &= (F.col(b) - F.col(a) >= low - HAIR) & (F.col(b) - F.col(a) <= high + HAIR)
    if how == "inner":
        return left.join(right, [*keys, *made]).where(within).drop(*made)
    other = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
    on = F.lit(True)
    for c in (*keys, *made):
        on &= F.col(c) == F.col(f"__{c}")
    for a, (b, low, high) in bands.items():
        on &= (F.col(f"__{b}") - F.col(a) >= low - HAIR) & (F.col(f"__{b}") - F.col(a) <= high + HAIR)
    return left.join(other, on, how).drop(*made)


def url_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\s", ""), "[./]+$", ""))


def lay_links(segments: DataFrame, links: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """Segments (page, number, text, x, y, font, width, rotation) with the addresses of the links (page, number, href, x, y, width, height) they show.

    A segment that reads like a link's address, begins where the link does and stands a line above it moves down to it; one on its line that
    is narrower becomes as wide. Stray marks left of a moved line go. Rotated segments and fonts over LARGEST_FONT stay.
    """
    top = F.greatest(F.lit(height) - F.col("y") - F.col("font"), F.lit(0.0))
    shows = F.col("text").contains("://") | F.col("text").contains("www.") | F.col("text").contains(".org/")
    asked = segments.where(shows & (F.abs("rotation") < 0.5) & (F.col("font") <= LARGEST_FONT)).select("page", F.col("number").alias("segment"), url_key(F.col("text")).alias("key"), F.col("x").alias("sx"), top.alias("stop"), "font", F.col("width").alias("swidth"))
    target = F.regexp_replace("href", "^https?://", "")
    given = links.where(target != "").select("page", F.col("number").alias("link"), target.alias("shown"), url_key(target).alias("key"), F.col("x").alias("lx"), F.greatest(F.lit(height) - F.col("y") - F.col("height"), F.lit(0.0)).alias("ltop"), F.col("width").alias("lwidth"))
    pairs = band_join(asked, given, ["page", "key"], {"sx": ("lx", -LARGEST_FONT, LARGEST_FONT), "stop": ("ltop", -LARGEST_FONT, 2.4 * LARGEST_FONT)})
    down = F.col("ltop") - F.col("stop")
    lower = (down >= F.col("font") * 0.9) & (down <= F.col("font") * 2.4)
    same = (F.abs(down) <= F.col("font") * 0.4) & (F.col("swidth") < F.col("lwidth") * 0.9)
    pairs = pairs.where(F.abs(F.col("sx") - F.col("lx")) <= F.greatest("font", F.lit(8.0))).withColumn("kind", F.when(lower, 0).when(same, 1)).where("kind is not null")
    best = pairs.groupBy("page", "segment").agg(F.min(F.struct("kind", "link", "shown", "ltop", "lwidth")).alias("link")).select(F.col("page").alias("__page"), F.col("segment").alias("__number"), "link")
    laid = segments.join(best, (F.col("page") == F.col("__page")) & (F.col("number") == F.col("__number")), "left")
    moved = F.col("link.kind") == 0
    laid = laid.select(
        "page", "number", F.coalesce("link.shown", "text").alias("text"), "x", F.when(moved, F.lit(height) - F.col("link.ltop") - F.col("font")).otherwise(F.col("y")).alias("y"), "font",
        F.when(F.col("link").isNotNull(), F.greatest("width", "link.lwidth")).otherwise(F.col("width")).alias("width"), "rotation", F.coalesce(moved, F.lit(False)).alias("moved"),
    )
    lines = laid.where("moved").select("page", F.col("y").alias("line"))
    mark = F.trim("text").isin("E", "I", "(") & (F.col("x") <= 70.0) & (F.col("font") <= LARGEST_FONT)
    reach = 0.65 * LARGEST_FONT
    # A mark's own font decides how near is near; it goes into the pair through a column of its own.
    near = band_join(laid.where(mark).select("page", F.col("number").alias("marked"), F.col("y").alias("at"), F.col("font").alias("size")), lines, ["page"], {"at": ("line", -reach, reach)})
    stray = near.where(F.abs(F.col("line") - F.col("at")) <= F.col("size") * 0.65).select(F.col("page").alias("__page"), F.col("marked").alias("__number")).distinct()
    return laid.join(stray, (F.col("page") == F.col("__page")) & (F.col("number") == F.col("__number")), "left_anti")


def sum_signs(lines: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """Where formulas lack their sum sign: page, x, y, font of a sign between an upper bound, a lower bound, a term on the right and a label on the left.

    lines: page, number, text, x, y, font, width; a line's cells are lines of their own.
    """
    at = F.greatest(F.lit(height) - F.col("y") - F.col("font"), F.lit(0.0))
    rows = lines.select("page", "number", F.regexp_replace("text", r"\s", "").alias("bare"), F.col("text"), F.col("x"), at.alias("top"), "font", "width").where("page is not null and x is not null and top is not null")
    small = F.col("font").between(6, 10)
    upper = rows.where(F.trim("text").isin("39", "40") & small & F.col("top").between(height * 0.25, height * 0.78)).select("page", F.col("number").alias("upper"), F.col("x").alias("ux"), F.col("top").alias("utop"))
    lower = rows.where(F.col("bare").rlike("^h.*[0-9]") & (F.octet_length("bare") <= 12) & small).select("page", F.col("number").alias("lower"), F.col("x").alias("lx"), F.col("top").alias("ltop"))
    term = rows.where(F.col("bare").isin("I", "Ih", "I1", "Ih2") & F.col("font").between(8, 12)).select("page", F.col("number").alias("term"), F.col("x").alias("tx"), F.col("top").alias("ttop"), F.col("font").alias("tfont"))
    label = rows.where(F.col("bare").isin("THC", "THD", "POHC")).select("page", (F.col("x") + F.col("width")).alias("bend"), F.col("top").alias("btop"))
    signs = rows.where(F.col("text").rlike("[Σ∑]")).select("page", F.col("x").alias("gx"), F.col("top").alias("gtop"))
    one = ["page", "upper", "ux", "utop"]
    found = band_join(upper, lower, ["page"], {"ux": ("lx", -16.0, 16.0), "utop": ("ltop", 12.0, 36.0)}).where("abs(lx - ux) <= 16 and ltop > utop + 12 and ltop <= utop + 36")
    found = found.groupBy(*one).agg(F.min(F.struct("lower", "ltop")).alias("l")).select(*one, "l.ltop")
    found = band_join(found, term, ["page"], {"ux": ("tx", 8.0, 36.0), "utop": ("ttop", 2.0, 38.0)}).where("tx > ux + 8 and tx <= ux + 36 and ttop >= utop + 2 and ttop <= ltop + 2")
    found = found.groupBy(*one, "ltop").agg(F.min(F.struct("term", "tfont")).alias("t")).select(*one, "ltop", "t.tfont")
    labelled = band_join(found, label, ["page"], {"utop": ("btop", 3.0, 44.0)}).where("bend < ux and btop >= utop + 3 and btop <= ltop + 8").select(*one, "ltop").distinct()
    signed = band_join(found, signs, ["page"], {"ux": ("gx", -18.0, 18.0), "utop": ("gtop", 0.0, 40.0)}).where("abs(gx - ux) <= 18 and gtop >= utop and gtop <= ltop + 4").select(*one, "ltop").distinct()
    found = found.join(labelled, [*one, "ltop"], "left_semi").join(signed, [*one, "ltop"], "left_anti")
    size = F.least(F.greatest(F.col("tfont") * 1.75, F.lit(14.0)), F.lit(19.0))
    top = F.greatest((F.col("utop") + F.col("ltop")) / 2 - size * 0.38, F.lit(0.0))
    return found.select("page", "upper", (F.col("ux") - size * 0.14).alias("x"), (F.lit(height) - top - size).alias("y"), size.alias("font"), (size * 0.45).alias("width"))


def fiscal_quarters(segments: DataFrame) -> DataFrame:
    """Segments (page, number, text, x, y, font, width, rotation) with 43 and 44 right after a year of 20.. on one line read as Q3 and Q4, in ``fixed``.

    Right after: no more than 0.75 font sizes to the right and 0.15 to the left of its end, by the larger of both fonts.
    """
    upright = segments.where((F.abs("rotation") < 0.5) & (F.col("font") <= LARGEST_FONT))
    years = upright.where(F.col("text").rlike("^20[0-9]{2}$")).select("page", (F.col("x") + F.col("width")).alias("yend"), F.col("x").alias("yx"), F.col("y").alias("yy"), F.col("font").alias("yfont"))
    key = ["page", "number", "x", "y", "font"]
    asked = upright.where(F.col("text").isin("43", "44")).select(*key).distinct()
    pairs = band_join(years, asked, ["page"], {"yend": ("x", -0.15 * LARGEST_FONT, 0.75 * LARGEST_FONT), "yy": ("y", -0.25 * LARGEST_FONT, 0.25 * LARGEST_FONT)})
    size, gap = F.greatest("font", "yfont", F.lit(1.0)), F.col("x") - F.col("yend")
    met = pairs.where((F.abs(F.col("yy") - F.col("y")) <= size * 0.25) & (F.abs(F.col("font") - F.col("yfont")) <= size * 0.15) & (gap >= size * -0.15) & (gap <= size * 0.75) & (F.col("yx") <= F.col("x")))
    met = met.select(*key).distinct().withColumn("__met", F.lit(True))
    out = segments.join(met, key, "left")
    return out.withColumn("fixed", F.when(F.col("__met") & (F.col("text") == "43"), "Q3").when(F.col("__met") & (F.col("text") == "44"), "Q4").otherwise(F.col("text"))).drop("__met")


def anchor_to_right(x: Column, font: Column, anchors: Column) -> Column:
    """The nearest of a page's anchors right of a place, within three font sizes and 18 points at least; null without any."""
    reach = F.greatest(F.greatest(font, F.lit(6.0)) * 3, F.lit(18.0))
    return F.array_min(F.filter(anchors, lambda a: (a > x) & (a - x <= reach)))
