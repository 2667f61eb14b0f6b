"""Bounding boxes of the borders of a mask, from runs of set pixels and a union-find.

Set pixels touch in eight directions, others in four. Each region of set pixels has an
outer border. Each region of others that does not reach the image's edge is a hole, whose
border lies on the set pixels around it: its box is a pixel larger on every side.
"""

from __future__ import annotations

import numpy as np


def _runs(mask: np.ndarray):
    """(row, first, end) of the runs of set pixels, in raster order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return y, a, b


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each node's set, by hooking and jumping over all links at once."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _regions(mask: np.ndarray, reach: int) -> np.ndarray:
    """Boxes (x0, y0, x1, y1) of regions, by their first pixel; reach 1: diagonals touch."""
    y, a, b = _runs(mask)
    # runs of the row above that overlap: they follow each other, as runs are in raster order
    wide = mask.shape[1] + 4
    low = np.searchsorted((y + 1) * wide + b + reach, y * wide + a, side="right")
    high = np.searchsorted((y + 1) * wide + a, y * wide + b + reach, side="left")
    n = np.maximum(high - low, 0)
    own = np.repeat(np.arange(len(y)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    roots = _joined(len(y), own, above)
    firsts, at = np.unique(roots, return_inverse=True)
    out = np.empty((len(firsts), 4), int)
    out[:, :2], out[:, 2:] = 1 << 30, -1
    for column, values, ufunc in ((0, a, np.minimum), (1, y, np.minimum), (2, b, np.maximum), (3, y + 1, np.maximum)):
        ufunc.at(out[:, column], at, values)
    return out


def contour_boxes(mask: np.ndarray) -> np.ndarray:
    """Rows of (hole, x, y, width, height) of every border, last ones in raster order first."""
    h, w = mask.shape
    outer, inner = _regions(mask, 1), _regions(~mask, 0)
    inner = inner[(inner[:, :2] > 0).all(axis=1) & (inner[:, 2] < w) & (inner[:, 3] < h)] + np.array([-1, -1, 1, 1])
    x0, y0, x1, y1 = np.concatenate([outer, inner]).T
    hole = np.arange(len(x0)) >= len(outer)
    return np.stack([hole, x0, y0, x1 - x0, y1 - y0], axis=1)[np.lexsort((-x0, -y0))]
