"""Grey images made ready for recognition, in numpy."""

from __future__ import annotations

import numpy as np


def stretched(grey: np.ndarray, low: float = 0.005, high: float = 0.01) -> np.ndarray:
    """Contrast stretched between the darkest and brightest shares of the histogram."""
    if grey.size == 0:
        return grey
    sums = np.cumsum(np.bincount(grey.ravel(), minlength=256))
    a = int(np.searchsorted(sums, grey.size * low, side="right"))
    b = int(np.searchsorted(sums, grey.size * (1 - high), side="left"))
    if b <= a:
        return grey
    return np.clip((grey.astype(np.float32) - a) * 255 / (b - a), 0, 255).astype(np.uint8)


def thresholded(grey: np.ndarray, window: int | None = None, share: float = 0.15) -> np.ndarray:
    """Black where a pixel is darker than its neighbourhood's mean by ``share``; means come from one table of sums."""
    h, w = grey.shape
    half = max(1, (window or max(w // 8, 3)) // 2)
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = grey.astype(np.int64).cumsum(0).cumsum(1)
    y0, y1 = np.clip(np.arange(h) - half, 0, h), np.clip(np.arange(h) + half + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - half, 0, w), np.clip(np.arange(w) + half + 1, 0, w)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return np.where(grey.astype(np.int64) * area <= total * (1 - share), 0, 255).astype(np.uint8)
