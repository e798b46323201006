"""Content operators of pages: an order of ``lineitem`` is a page, its lines are what is painted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import graphics
from docstrata.session import table

#: A line saves and turns the page, sets its colour and width, gives a box and a path, and paints or restores, by its number.
_OPERATORS = """filter(array(
  CASE WHEN l_linenumber % 3 = 0 THEN struct('q' AS name, cast(array() AS array<double>) AS args) END,
  CASE WHEN l_linenumber % 3 = 0 THEN struct('cm' AS name, array(1 + l_discount, l_tax, -l_tax, 1 + l_discount, l_quantity, l_tax * 100) AS args) END,
  struct(CASE WHEN l_linenumber % 2 = 0 THEN 'rg' ELSE 'RG' END AS name, array(l_tax * 12, l_discount * 10, 0.5D) AS args),
  struct('w' AS name, array(l_quantity / 10 - 2) AS args),
  CASE WHEN l_linenumber % 4 = 1 THEN struct('d' AS name, array(3D, l_tax * 100, 0D) AS args) END,
  struct('re' AS name, array(l_quantity, l_discount * 100, 10D, l_tax * 100) AS args),
  CASE WHEN l_linenumber % 2 = 1 THEN struct('m' AS name, array(l_quantity, 5D) AS args) END,
  CASE WHEN l_linenumber % 2 = 1 THEN struct('l' AS name, array(l_quantity + 20, 5D) AS args) END,
  CASE WHEN l_linenumber % 5 = 1 THEN struct('c' AS name, array(1D, 2D, 3D, 4D, l_quantity, 6D) AS args) END,
  struct(CASE l_linenumber % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'b' WHEN 2 THEN 'f' WHEN 3 THEN 'S' ELSE 's' END AS name, cast(array() AS array<double>) AS args),
  CASE WHEN l_linenumber % 3 = 2 THEN struct('Q' AS name, cast(array() AS array<double>) AS args) END), x -> x IS NOT NULL)"""


def operators(lineitem: DataFrame) -> DataFrame:
    """page, operators: all operators of each order, numbered in the order of its lines."""
    rows = lineitem.where("l_orderkey is not null").select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_quantity", "l_tax", "l_discount").alias("r"))
    # Lines meet by their numbers; operators are made once they are in order.
    made = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("page", F.expr(f"flatten(transform(rs, r -> {re.sub(r'l_[a-z]+', r'r.\g<0>', _OPERATORS)}))").alias("ops"))
    return made.select("page", F.transform("ops", lambda o, k: F.struct(k.cast("bigint").alias("number"), o["name"].alias("name"), o["args"].alias("args"))).alias("operators"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every painted rectangle and path, with the state it was painted in."""
    rows = operators(table(spark, sf_dir, "lineitem")).select("page", F.posexplode(graphics.shapes(F.col("operators"))).alias("place", "s"))
    shown = lambda xs: F.array_join(F.transform(xs, lambda v: F.format_string("%.6f", v)), " ")
    return rows.select("page", "place", "s.number", "s.kind", "s.fill", "s.stroke", F.round("s.width", 6).alias("width"), shown(F.col("s.dash")).alias("dash"), shown(F.col("s.box")).alias("box"), F.array_join(F.transform("s.path", lambda c: F.concat_ws(" ", c["name"], shown(c["xy"]))), " ").alias("path"))


QUERIES = {"w18_graphics_state": shapes}
