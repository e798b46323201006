"""The stored index is written in small row groups and pages, so that no task holds many of its long rows."""

from pathlib import Path

import pyarrow.parquet as pq

from docstrata.llm import decontam
from docstrata.session import _STORED


def test_row_groups_hold_few_segments(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 1 << 14)
    monkeypatch.setattr(decontam, "STORED_AS", getattr(decontam, "STORED_AS", {}) | {"parquet.block.size": 1 << 17}, raising=False)
    words = [" ".join(f"w{k * 7919 % 100_003}x{k + d}" for k in range(1200)) for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").coalesce(1)
    stored = decontam.index(docs)
    path = _STORED[spark.sparkContext.applicationId][-1].removeprefix("file:")
    groups = [g for f in Path(path).rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(k).num_rows for k in range(m.num_row_groups))]
    assert stored.count() == sum(groups) == 60 and max(groups) <= 12
    item = spark.createDataFrame([("a", words[41][:200]), ("b", "none of this")], "item_id string, text string")
    assert [(r.doc_id, r["items"]) for r in decontam.search(stored, item).where("n_hit > 0").collect()] == [(41, ["a"])]
