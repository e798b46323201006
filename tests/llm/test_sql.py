"""The SQL of the training-data queries gives their rows, in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from docstrata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    shown = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(shown(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert plain(got) == plain(want)
