"""Queries of what lies near what: web addresses of ``pages`` laid on segments, formulas of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import placing
from docstrata.session import table

#: Eight addresses a page, 60 points apart; the length of a page's html moves its segment and its mark, over the borders of all bands.
_LINKS = "SELECT page_id // 8 AS page, page_id % 8 AS number, 'http://www.' || regexp_replace(url, '^https?://', '') AS href, 72.0 AS x, 700.0 - 60 * (page_id % 8) AS y, 5.4 * length(url) + length(html) % 5 * 3 AS width, 12.0 AS height FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"
_TEXT = "regexp_replace(url, '^https?://', '')"
_SEGMENTS = f"""SELECT page_id // 8 AS page, page_id % 8 AS number, CASE page_id % 3 WHEN 0 THEN 'www.' || {_TEXT} WHEN 1 THEN 'www.' || upper({_TEXT}) || '/ ' ELSE 'www. ' || {_TEXT} END AS text, 72.0 + length(html) % 31 - 15 AS x,
    700.0 - 60 * (page_id % 8) + 12 - font + length(html) % 9 * font * 0.35 AS y, font, 5.4 * length(url) - length(html) % 7 * 10 AS width, CASE WHEN length(html) % 41 = 0 THEN 90.0 ELSE 0.0 END AS rotation FROM (SELECT *, 10.0 + length(html) % 4 AS font FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) b
  UNION ALL SELECT page_id // 8, 8 + page_id % 8, CASE length(html) % 4 WHEN 0 THEN 'E' WHEN 1 THEN ' I' WHEN 2 THEN '(' ELSE 'x' END, 60.0 + length(html) % 20, 700.0 - 60 * (page_id % 8) + (length(html) % 11 - 5) * 2, 10.0, 8.0, 0.0 FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"""

#: An order is a page; its seven lines are bounds, terms, labels and signs, by number.
_FORMULAS = """SELECT l_orderkey AS page, l_linenumber AS number, CASE l_linenumber WHEN 1 THEN CASE WHEN l_quantity > 25 THEN '40' ELSE ' 39' END WHEN 2 THEN 'h = 2' WHEN 3 THEN CASE WHEN l_tax > 0.04 THEN 'I h' ELSE 'I1' END WHEN 4 THEN CASE WHEN l_quantity > 25 THEN 'THD' ELSE 'THC' END WHEN 5 THEN 'h2' WHEN 6 THEN CASE WHEN l_quantity > 30 THEN '∑ x' ELSE 'Ih2' END ELSE 'text' END AS text,
    CASE l_linenumber WHEN 3 THEN 304 WHEN 4 THEN 255 WHEN 6 THEN 305 ELSE 290 END + CAST(l_discount * 200 AS DOUBLE) AS x, CASE l_linenumber WHEN 1 THEN 430 WHEN 2 THEN 412 WHEN 5 THEN 404 ELSE 415 END + CAST(l_tax * 100 AS DOUBLE) AS y,
    CASE WHEN l_linenumber IN (3, 6) THEN 9.0 ELSE 8.0 END AS font, 20.0 AS width FROM lineitem"""


def _spark(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    table(spark, sf_dir, name).createOrReplaceTempView(f"docstrata_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM docstrata_{name}").replace("page_id // 8", "page_id div 8"))


def links_on_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.lay_links(_spark(spark, sf_dir, "pages", _SEGMENTS), _spark(spark, sf_dir, "pages", _LINKS)).selectExpr("page", "number", "text", "x", "round(y, 6) as y", "font", "round(width, 6) as width", "moved")


def sum_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.sum_signs(_spark(spark, sf_dir, "lineitem", _FORMULAS)).selectExpr("page", "upper", "round(x, 6) as x", "round(y, 6) as y", "font", "round(width, 6) as width")


#: By all pairs of a page.
_KEY = r"lower(regexp_replace(regexp_replace({}, '\s', '', 'g'), '[./]+$', ''))"
LINKS_SQL = rf"""WITH s AS (SELECT *, greatest(792 - y - font, 0) AS top FROM ({_SEGMENTS}) a), l AS (SELECT *, {_TEXT.replace("url", "href")} AS shown, greatest(792 - y - height, 0) AS top FROM ({_LINKS}) b),
p AS (
  SELECT s.page, s.number, l.number AS link, l.shown, l.top AS ltop, l.width AS lwidth,
    CASE WHEN l.top - s.top >= s.font * CAST(0.9 AS DOUBLE) AND l.top - s.top <= s.font * CAST(2.4 AS DOUBLE) THEN 0 WHEN abs(l.top - s.top) <= s.font * CAST(0.4 AS DOUBLE) AND s.width < l.width * CAST(0.9 AS DOUBLE) THEN 1 END AS kind
  FROM s JOIN l ON s.page = l.page AND {_KEY.format("s.text")} = {_KEY.format("l.shown")} AND abs(s.x - l.x) <= greatest(s.font, 8)
  WHERE abs(rotation) < 0.5 AND (contains(s.text, '://') OR contains(s.text, 'www.') OR contains(s.text, '.org/')) AND l.shown <> ''
), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, number ORDER BY kind, link) AS r FROM p WHERE kind IS NOT NULL) q WHERE r = 1),
m AS (SELECT s.page, s.number, coalesce(w.shown, s.text) AS text, s.x, CASE WHEN kind = 0 THEN 792 - ltop - font ELSE y END AS y, font, CASE WHEN kind IS NULL THEN width ELSE greatest(width, lwidth) END AS width, coalesce(kind = 0, false) AS moved FROM s LEFT JOIN w ON s.page = w.page AND s.number = w.number)
SELECT page, number, text, x, round(y, 6) AS y, font, round(width, 6) AS width, moved FROM m
WHERE NOT (trim(text) IN ('E', 'I', '(') AND x <= 70 AND EXISTS (SELECT 1 FROM m AS n WHERE n.moved AND n.page = m.page AND abs(m.y - n.y) <= m.font * CAST(0.65 AS DOUBLE)))"""
SIGNS_SQL = rf"""WITH t AS (SELECT *, regexp_replace(text, '\s', '', 'g') AS bare, greatest(792 - y - font, 0) AS top FROM ({_FORMULAS}) a),
u AS (SELECT * FROM t WHERE trim(text) IN ('39', '40') AND font BETWEEN 6 AND 10 AND top BETWEEN 198 AND 617.76),
l AS (SELECT u.page, u.number, u.x, u.top AS utop, min({{'n': t.number, 'v': t.top}}).v AS ltop FROM u JOIN t ON t.page = u.page AND regexp_matches(t.bare, '^h.*[0-9]') AND strlen(t.bare) <= 12 AND t.font BETWEEN 6 AND 10 AND abs(t.x - u.x) <= 16 AND t.top > u.top + 12 AND t.top <= u.top + 36 GROUP BY ALL),
k AS (SELECT l.page, l.number, l.x, utop, ltop, min({{'n': t.number, 'v': t.font}}).v AS tfont FROM l JOIN t ON t.page = l.page AND t.bare IN ('I', 'Ih', 'I1', 'Ih2') AND t.font BETWEEN 8 AND 12 AND t.x > l.x + 8 AND t.x <= l.x + 36 AND t.top >= utop + 2 AND t.top <= ltop + 2 GROUP BY ALL),
o AS (SELECT *, least(greatest(tfont * 1.75, 14), 19) AS size FROM k WHERE EXISTS (SELECT 1 FROM t WHERE t.page = k.page AND t.bare IN ('THC', 'THD', 'POHC') AND t.x + t.width < k.x AND t.top >= utop + 3 AND t.top <= ltop + 8)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = k.page AND regexp_matches(t.text, '[Σ∑]') AND abs(t.x - k.x) <= 18 AND t.top >= utop AND t.top <= ltop + 4))
SELECT page, number AS upper, round(x - size * 0.14, 6) AS x, round(792 - greatest((utop + ltop) / 2 - size * 0.38, 0) - size, 6) AS y, size::DOUBLE AS font, round(size * 0.45, 6)::DOUBLE AS width FROM o"""

#: An order is a page whose lines hold a year, a quarter that may follow it, and other numbers.
_YEARS = """SELECT l_orderkey AS page, l_linenumber AS number, CASE l_linenumber % 3 WHEN 1 THEN CASE WHEN l_discount < 0.08 THEN '2024' ELSE '1999' END WHEN 2 THEN CASE WHEN l_tax < 0.04 THEN '43' ELSE '44' END ELSE '43.5' END AS text,
    CASE l_linenumber % 3 WHEN 1 THEN 100 ELSE 120 END + CAST(l_quantity / 4 AS DOUBLE) AS x, 500 - 20 * (l_linenumber // 3) + CAST(l_discount * 40 AS DOUBLE) AS y, 10 + CAST(l_tax * 30 AS DOUBLE) AS font, 18.0 AS width,
    CASE WHEN l_quantity > 48 THEN 90.0 ELSE 0.0 END AS rotation FROM lineitem"""


def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.fiscal_quarters(_spark(spark, sf_dir, "lineitem", _YEARS.replace("l_linenumber // 3", "l_linenumber div 3"))).select("page", "number", "x", "y", "fixed")


def anchors_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's place moved to the anchor right of it; a page's anchors are its distinct rounded places."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").selectExpr("l_orderkey AS page", "l_linenumber AS number", "CAST(l_quantity AS DOUBLE) AS x", "CAST(4 + l_tax * 50 AS DOUBLE) AS font")
    anchors = rows.groupBy("page").agg(F.collect_set(F.round(F.col("x") / 8) * 8).alias("anchors"))
    return rows.join(anchors, "page").select("page", "number", "x", "font", F.coalesce(placing.anchor_to_right(F.col("x"), F.col("font"), F.col("anchors")), F.col("x")).alias("moved"))


QUARTERS_SQL = f"""WITH s AS ({_YEARS})
SELECT page, number, x, y, CASE WHEN text IN ('43', '44') AND rotation < 0.5 AND EXISTS (SELECT 1 FROM s AS o WHERE o.page = s.page AND o.rotation < 0.5 AND regexp_matches(o.text, '^20[0-9][0-9]$') AND o.x <= s.x
  AND abs(o.y - s.y) <= greatest(o.font, s.font) * 0.25 AND abs(o.font - s.font) <= greatest(o.font, s.font) * 0.15 AND s.x - (o.x + o.width) >= greatest(o.font, s.font) * -0.15 AND s.x - (o.x + o.width) <= greatest(o.font, s.font) * 0.75)
  THEN CASE text WHEN '43' THEN 'Q3' ELSE 'Q4' END ELSE text END AS fixed FROM s"""
ANCHORS_SQL = """WITH r AS (SELECT l_orderkey AS page, l_linenumber AS number, CAST(l_quantity AS DOUBLE) AS x, CAST(4 + l_tax * 50 AS DOUBLE) AS font FROM lineitem), a AS (SELECT DISTINCT page, round(x / 8) * 8 AS anchor FROM r)
SELECT page, number, x, font, coalesce((SELECT min(anchor) FROM a WHERE a.page = r.page AND anchor > r.x AND anchor - r.x <= greatest(greatest(r.font, 6) * 3, 18)), x) AS moved FROM r"""

QUERIES = {"j23_links_on_segments": links_on_segments, "j26_sum_signs": sum_signs, "w07_fiscal_quarters": fiscal_quarters, "o08_anchor_to_right": anchors_to_right}
ORACLES = {"j23_links_on_segments": LINKS_SQL, "j26_sum_signs": SIGNS_SQL, "w07_fiscal_quarters": QUARTERS_SQL, "o08_anchor_to_right": ANCHORS_SQL}
