"""The WARC queries leave references without a semicolon as their SQL does; the operator reads them as HTML does."""

import duckdb
import pytest

from docstrata.llm import warc
from docstrata.llm.queries import ORACLES, QUERIES

PAGES = [
    (1, "u/1", "<title>Ly&amp;&amp;&amp; and&amp</title><h1>Ly&amp;&amp;&amp; and&amp</h1><p>To&copy; &middot; x"),
    (2, "u/2", "<title>a &quo</title><h1>a &quot</h1><p>b &lt c &gt &nbsp d &copy 1 &am; &a &amp"),
    (3, "u/3", "<p>&ampx; &ampamp; &ltb &lt;b&gt; &amp;amp &amp;amp; &quot;&apos;&#39;&nbsp;&nbsp;; &&amp;; &AMP &notit; &;</p>&amp"),
    (3, "u/3", "<p>&amp</p>"),
    (4, None, None),
    (5, "u/5", "&amp"),
    (6, "u/6", "<p>no reference</p>"),
]
CUT = "<p>caf&eacute; &#8217; &#x2014; &#xa0;x &bogus; &amp;eacute; &ampx; &notit; &eacute &#8217 &amp</p>"


@pytest.mark.parametrize("name", ["op2_warc_derivatives", "warc_files"])
def test_references_without_a_semicolon_are_those_of_the_sql(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    rows = lambda frame: sorted(tuple(map(str, row)) for row in frame.itertuples(index=False))
    assert len(want) == 2 * len(PAGES) and rows(got) == rows(want)


def test_every_reference_with_a_semicolon_is_decoded(spark):
    source = warc.responses(spark.createDataFrame([(1, "u", CUT)], "page_id bigint, url string, html string"))
    block = lambda **how: warc.derive(source, **how).where("record_type = 'conversion'").first().block
    assert block(closed=True) == "café ’ — x &bogus; &eacute; &ampx; &notit; &eacute &#8217 &amp"
    assert block() == "café ’ — x &bogus; &eacute; &x; ¬it; é ’ &"


def test_long_names_are_linear():
    for text in ("&" + "a" * 2_000_000, "&" * 2_000_000, "&#" + "1" * 2_000_000, "&#" * 1_000_000):
        assert warc.decode_closed(text) == text
    assert warc.decode_closed("&#" + "1" * 2_000_000 + ";" + "&#" + "0" * 2_000_000 + "65;") == "�A"
