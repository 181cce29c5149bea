"""Nearest element below a bound, for many probes at once."""

from __future__ import annotations

import numpy as np


def nearest_smaller(values: np.ndarray, at: np.ndarray, bound: np.ndarray, direction: int) -> np.ndarray:
    """First j from ``at`` on (``direction`` 1: upwards, -1: downwards, ``at``
    included) with ``values[j] < bound``; -1 if there is none.

    A pyramid of pairwise minima lets every probe climb while a cell has nothing
    small enough and descend where one has.
    """
    values = values if direction > 0 else values[::-1]
    at = at if direction > 0 else len(values) - 1 - at
    levels = [values]
    while len(levels[-1]) > 1:
        level = levels[-1]
        if len(level) % 2:
            level = np.append(level, np.iinfo(level.dtype).max)
        levels.append(np.minimum(level[0::2], level[1::2]))
    node, height = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
    found = np.zeros(len(at), dtype=bool)
    for h, level in enumerate(levels):  # climb
        todo = ~found & (node < len(level))
        hit = np.zeros(len(at), dtype=bool)
        hit[todo] = level[node[todo]] < bound[todo]
        height[hit] = h
        found |= hit
        odd = ~found & (node % 2 == 1)
        # a right child moves on to the cell after its parent
        node = np.where(found, node, node // 2 + odd)
    for h in range(len(levels) - 1, 0, -1):  # descend
        down = found & (height == h)
        left = node[down] * 2
        child = levels[h - 1]
        node[down] = np.where(child[left] < bound[down], left, left + 1)
        height[down] = h - 1
    out = np.where(found, node, -1)
    return out if direction > 0 else np.where(found, len(values) - 1 - out, -1)
