"""Vectors from Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values as doubles, starts, ends, valid) of a list column.

    Not valid: null vectors, empty ones and those with null or non-finite components.
    """
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    starts, ends = offsets[:-1], offsets[1:]
    gaps = np.asarray(values.is_null())
    flat = np.asarray(values.fill_null(0).cast(pa.float64()) if gaps.any() else values.cast(pa.float64()))
    bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(flat))])
    valid = ~np.asarray(column.is_null()) & (ends > starts) & (bad[ends] == bad[starts])
    return flat, starts, ends, valid
