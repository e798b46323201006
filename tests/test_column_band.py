"""``j18_column_band`` by lines against its SQL by words, on texts at the edges of the band."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from docstrata import catalog


def texts():
    r = random.Random(2)
    word = lambda: r.choice(("a", "bc,", "def.", "ghij", "é", "..", ",", "klmnopqrstuvwx", "", "", "\t", "y" * 40, "\U0001f600"))
    out = [None, "", "\n", " " * 200, " " * 95 + "x", " " * 88 + "x\n" + "z" * 30 + " q\n", " " * 36 + "x\n" * 20, " ".join("w" * 300), "x" * 70 + " y", "x" * 60 + " y\n" + " " * 100 + "late"]
    for _ in range(150):
        out.append("\n".join(" ".join(word() for _ in range(r.choice((0, 1, 5, 20, 60)))) for _ in range(r.randrange(1, 30))))
    return out


def test_band_by_lines(spark, tmp_path):
    values = texts()
    rows = pa.table({"doc_id": pa.array([None, *range(1, len(values) - 1), 3], pa.int64()), "text": pa.array(values), "source": ["s"] * len(values), "lang": ["en"] * len(values)})
    pq.write_table(rows.slice(0, len(values) - 1), tmp_path / "documents.parquet")
    got = catalog.QUERIES["j18_column_band"](spark, str(tmp_path))
    # Words are not rows: lines are the only ones that are made.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") + got._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(catalog.ORACLES["j18_column_band"]).fetchall()
    plain = lambda found: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in found)
    assert plain(map(tuple, got.collect())) == plain(want) and len({r[3] for r in want}) == 2 and len(want) > 500
