"""Connected components: of a link table by the core's stars, and inside one task."""

from __future__ import annotations

import numpy as np

from lakewright.operators.graph import connected_components, local_roots  # noqa: F401


def least_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least id that links between positions i and j reach from each position."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return ids[order][local_roots(len(ids), rank[i], rank[j])][rank]
