"""Whitening against numpy on whole tables, and its hard rows."""

import numpy as np
import pytest

from docstrata.llm import whitening


def plain(vectors):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(((n * x - sums) / n).T @ ((n * x - sums) / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - sums) ** 2).sum(axis=1), (n * x - sums) / n @ axes / np.sqrt(values), values / values.sum()


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, part string, block string").repartition(parts)


def test_against_numpy(spark, monkeypatch):
    # Blocks of 7 rows: several a task, the last of each filled up, laid out as a grid.
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 7 * 40)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 40)) @ np.diag(np.linspace(2, 0.2, 40)) + rng.normal(size=40) * 9).astype(np.float32)
    rows = [(i, v.tolist(), "p", None) for i, v in enumerate(vectors)]
    bad = [(900, None, "", ""), (901, [], "", ""), (902, [1.0] * 39 + [None], "", ""), (903, [1.0] * 39 + [float("nan")], "", ""), (904, [float("inf")] + [0.0] * 39, "", ""), (905, [1.0] * 39, "", "")]
    got = whitening.whiten(table(spark, rows + bad)).toPandas()
    deviation, white, share = plain(vectors.astype(float))
    assert len(got) == 150 * 32 and set(got.n) == {150} and set(got.component) == set(range(1, 33))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((wide * white[:, :32]).sum(axis=0))
    assert np.abs(wide * signs - white[:, :32]).max() < 1e-9
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == dict(enumerate(deviation.tolist()))
    assert np.allclose(got.sort_values(["vec_id", "component"]).explained.to_numpy().reshape(150, 32), share[:32], rtol=1e-9)
    errors = set(got.identity_error)
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_nulls_repeats_and_few_components(spark):
    rows = [(None, [0.5, 3.0, 1.0], "", ""), (None, [0.5, 3.0, 1.0], "", ""), (7, [2.0, 3.0, 9.0], "", ""), (7, [1.0, 3.0, 4.0], "", "")]
    got = whitening.whiten(table(spark, rows, 2)).toPandas()
    # The second entry never changes: two components.
    assert len(got) == 8 and got.vec_id.isna().sum() == 4 and sorted(set(got.component)) == [1, 2]
    assert got.identity_error.max() < 1e-9 and np.isfinite(got.whitened).all()


@pytest.mark.parametrize("rows", [[], [(1, None, "", "")], [(1, [1.0, 2.0], "", "")] * 3])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30], "", ""), (2, [0.0], "", "")])).collect()
