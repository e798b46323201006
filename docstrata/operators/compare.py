"""Comparison of two texts: similarity, line statistics and a side-by-side difference."""

from __future__ import annotations

import difflib
import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(value: str | None) -> list[str]:
    return [x for x in (" ".join(part.split()) for part in (value or "").split("\n")) if x]


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of the lower-cased lines' words, in per cent."""
    x, y = (" ".join(lines(t)).casefold().split() for t in (a, b))
    return round(100 * difflib.SequenceMatcher(None, x, y).ratio(), 1)


def line_stats(a: list[str], b: list[str]) -> dict[str, int]:
    out = {"matching": 0, "left_only": 0, "right_only": 0, "changed": 0}
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out["matching"] += j - i
        elif tag == "delete":
            out["left_only"] += j - i
        elif tag == "insert":
            out["right_only"] += m - k
        else:
            out["changed"] += max(j - i, m - k)
    return out


def diff_html(a: list[str], b: list[str], context: int = 3) -> str:
    rows = []
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        for tag, i, j, k, m in group:
            for n in range(max(j - i, m - k)):
                left, right = a[i + n] if i + n < j else "", b[k + n] if k + n < m else ""
                rows.append(f'<tr class="{tag}"><td>{html.escape(left)}</td><td>{html.escape(right)}</td></tr>')
    return "<table>" + "".join(rows) + "</table>"


def compare(pairs: DataFrame) -> DataFrame:
    """pairs (key columns..., left_text, right_text) with score, band, line statistics and the difference."""
    keys = [f for f in pairs.schema.fields if f.name not in ("left_text", "right_text")]
    names = [f.name for f in keys]
    made = ["score", "matching", "left_only", "right_only", "changed", "diff"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b in zip(batch["left_text"], batch["right_text"], strict=True):
                x, y = lines(a), lines(b)
                rows.append({"score": ratio(a, b), **line_stats(x, y), "diff": diff_html(x, y)})
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(rows, columns=made)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "score double, matching bigint, left_only bigint, right_only bigint, changed bigint, diff string"])
    out = pairs.select(*[f"`{n}`" for n in names], "left_text", "right_text").mapInPandas(run, schema)
    return out.withColumn("band", F.when(F.col("score") >= 95, "Very close").when(F.col("score") >= 80, "Mostly similar").when(F.col("score") >= 60, "Partly similar").otherwise("Substantially different"))
