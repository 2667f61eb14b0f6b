"""Boxes of one image in NumPy: the rules of ``functions.geometry`` for the engine's Python stage. Queries over images hold both to the same SQL."""

from __future__ import annotations

import numpy as np

from pagewright.functions.geometry import LEAST_SIDE


def half_up(x) -> np.ndarray:
    """Round halves toward positive infinity, for every double."""
    whole = np.floor(x)
    return (whole + (x - whole >= 0.5)).astype(int)


def in_image(found: np.ndarray, model_size: tuple[int, int], ratio: float, image_size: tuple[int, int], options) -> np.ndarray:
    """Rows of (x, y, width, height) on the model's map to boxes in the image's own pixels; those that are too small go."""
    found = found[found[:, 2] * found[:, 3] > options.min_area]
    x, y, w, h = found.T
    v, s = half_up(h * options.pad_vertical), half_up(h * options.pad_horizontal)
    x0, y0 = np.maximum(0, x - s), np.maximum(0, y - v)
    x1, y1 = np.minimum(model_size[0], x + w + s), np.minimum(model_size[1], y + h + v)
    left, top = np.maximum(0, half_up(x0 / ratio)), np.maximum(0, half_up(y0 / ratio))
    width = np.minimum(image_size[0] - left, half_up((x1 - x0) / ratio))
    height = np.minimum(image_size[1] - top, half_up((y1 - y0) / ratio))
    return np.stack([left, top, width, height], axis=1)[(width > LEAST_SIDE) & (height > LEAST_SIDE)]
