"""Links inside blocks of a boolean matrix, without listing all pairs."""

from __future__ import annotations

import numpy as np


def lowest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a rows x columns matrix of links: the label of each row's and each column's connected part.

    Labels are numbers of rows; a column without a link has label -1.  Each round lowers the labels along all links at
    once.
    """
    m, n = linked.shape
    rows = np.arange(m)
    cols = np.full(n, m)
    while True:
        wide = np.where(linked, rows[:, None], m).min(axis=0) if m else cols
        cols = np.minimum(cols, wide)
        low = np.minimum(rows, np.where(linked, cols[None, :], m).min(axis=1)) if n else rows
        low = np.minimum(low, low[low])
        if (low == rows).all():
            return rows, np.where(cols == m, -1, cols)
        rows = low
