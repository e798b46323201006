"""Nested columns as flat ones and back, for folds over a batch of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sizes(lists: pa.Array) -> list[int]:
    """How many values each list has; null has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


def lists(lengths: list[int], values: pa.Array) -> pa.Array:
    """Values as lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), pa.int32()), values)
