"""Running totals and places against plain loops; no window without a partition."""

import random

from docstrata.operators import prefix


def unpartitioned(df):
    """Whether the plan, or what it read, ran a window over all rows in one task."""
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), k, rng.choice([None, 0, 1, 5, -2])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    got = prefix.running_total(df, ["g", "k"], "n", "before")
    assert not unpartitioned(got)
    total, want = 0, {}
    for g, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[k] = total
        total += n or 0
    assert {r.k: r.before for r in got.collect()} == want
    assert prefix.running_total(df.limit(0), ["g"], "n", "before").count() == 0


def test_places(spark):
    rng = random.Random(3)
    # One key holds most rows, and null is a key.
    rows = [("hot" if rng.random() < 0.8 else rng.choice([None, "x", "y"]), k) for k in range(300)]
    got = prefix.places(spark.createDataFrame(rows, "g string, k int").repartition(4), "g", ["k"], "place")
    assert not unpartitioned(got)
    seen, want = {}, {}
    for g, k in rows:
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert {r.k: r.place for r in got.collect()} == want
