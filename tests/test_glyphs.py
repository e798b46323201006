"""Codes read from the left, the longest first, and outlines that agree, on literal tables."""

from docstrata import catalog


def test_decode_counts(spark, tmp_path):
    spark.createDataFrame([("abcbzz",), (None,), ("Q",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Pairs known: ab, bc, cb, bz; zz is no pair of two letters.
    texts = [(1, "abc\nbzz"), (2, "aab1.Z"), (3, None), (4, ""), (5, "bcb,"), (None, "z")]
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts], "doc_id int, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.mapped, r.fallback, r.notdef, r.raw, r.n_shown) for r in catalog.QUERIES["g23_m31_decode_counts"](spark, str(tmp_path)).collect()}
    # ab|c, bz|z: the pair that begins first is read; a|ab|1|.|Z; bc|b|,.
    assert got == {1: (3, 0, 0, 1, 4), 2: (2, 1, 1, 1, 4), 5: (2, 0, 1, 0, 2), None: (0, 0, 0, 1, 1)}


def test_outlines(spark, tmp_path):
    lines = {1: [(1, 8.0), (2, 16.0)], 2: [(2, 16.0), (1, 8.0)], 3: [(1, 8.0), (2, 16.0)], 4: [(1, 16.0), (2, 8.0)], 5: [(1, 16.0), (2, 8.0)], 6: [(1, 80.0)], 7: [(1, 80.0)], 8: [(1, 80.0)], 9: [(1, 88.0)], 10: [(1, 88.0)]}
    spark.createDataFrame([(k, n, q, 0.0, "A") for k, ls in lines.items() for n, q in ls], "l_orderkey int, l_linenumber int, l_quantity double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    # 1 is known and 2, 3 have its outline, in whatever order their rows come; 4's order of commands is another one; 6 and 7 don't agree; 9 shows two signs.
    orders = [(1, "F", 1, "5-LOW"), (2, "O", 1, "1-X"), (3, "P", 1, "1-X"), (4, "F", 1, "2-X"), (5, "O", 1, "1-X"), (6, "F", 1, "3-X"), (7, "F", 1, "4-X"), (8, "O", 1, "1-X"), (9, "F", 5, "3-X"), (10, "O", 1, "1-X")]
    spark.createDataFrame(orders, "o_orderkey int, o_orderstatus string, o_custkey int, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.o_orderkey, r.text) for r in catalog.QUERIES["u08_outline_signatures"](spark, str(tmp_path)).collect()} == {(2, "5"), (3, "5"), (5, "2")}


def test_codes_are_read_without_moving_lines(spark, tmp_path):
    """Known codes are one pattern, so lines meet them without a join; signs beyond ASCII count once, and without a known code all are single."""
    spark.createDataFrame([(1, "ab"), (2, None), (3, "cx")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "ababx\nz9.\U0001f600", "en", "s"), (2, "", "en", "s"), (3, "bcx", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.QUERIES["g23_m31_decode_counts"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in made.collect()) == [(1, 2, 1, 1, 3, 6), (3, 2, 0, 0, 0, 2)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
