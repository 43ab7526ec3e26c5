"""Places on a space-filling curve."""

from __future__ import annotations

import numpy as np


def hilbert(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of cells of a 65536 by 65536 grid on the Hilbert curve."""
    x, y, d = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for bit in reversed(range(16)):
        right, up = x >> bit & 1, y >> bit & 1
        d = d * 4 + (3 * right ^ up)
        flip = (right == 1) & (up == 0)
        x, y = np.where(flip, 65535 - x, x), np.where(flip, 65535 - y, y)
        x, y = np.where(up == 1, x, y), np.where(up == 1, y, x)
    return d
