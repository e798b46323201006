"""Intermediate tables go when they are released, and only those."""

import os

from docstrata.session import release, shared_folder, stored_path


def test_release(spark):
    release(spark)
    path, other = stored_path(spark, "one"), f"{shared_folder(spark)}/kept"
    for at in (path, other):
        spark.range(3).write.mode("overwrite").parquet(at)
    assert spark.read.parquet(path).count() == 3
    assert release(spark) == 1 and release(spark) == 0
    assert not os.path.exists(path.removeprefix("file:")) and spark.read.parquet(other).count() == 3
