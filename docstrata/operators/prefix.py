"""Running totals and places in one global order, without one task that sees all rows.

Rows are dealt by ranges of their order and stored in the shared folder with the number
of their range, so that every later step sees the same ranges. Totals inside a range are
a window over that range; what stands before a range is the sum of the earlier ranges'
sums, one row for each range.

Defined cases: nulls sort first, and a null value adds nothing; rows that are equal in
the order follow each other in any way; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.session import stored_path


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before each in the order, as a bigint."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = stored_path(spark, "ranges")
    df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()).write.parquet(at)
    stored = spark.read.parquet(at)
    before, offsets = 0, []
    for r in sorted(stored.groupBy("__range").agg(F.sum(value).alias("n")).collect(), key=lambda r: r["__range"]):
        offsets.append((r["__range"], before))
        before += r["n"] or 0
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # One row a range, at most as many as there are shuffle partitions.
    known = F.broadcast(spark.createDataFrame(offsets, "__range int, __before bigint"))
    return stored.withColumn("__inside", inside).join(known, "__range").withColumn(name, (F.coalesce("__inside", F.lit(0)) + F.col("__before")).cast("bigint")).drop("__range", "__inside", "__before")


def places(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The rows numbered from 1 inside each key; a key may hold most of the rows, since they are numbered all together first."""
    rows = running_total(df.withColumn("__one", F.lit(1)), [key, *order], "__one", "__place")
    first = rows.groupBy(key).agg(F.min("__place").alias("__first")).withColumnRenamed(key, "__key")
    return rows.join(first, rows[key].eqNullSafe(first["__key"])).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__one", "__place", "__first", "__key")
