"""The best rows of each query from blocks of scores, in one pass over the rows with a bounded state."""

from __future__ import annotations

import numpy as np


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


class Best:
    """The ``k`` best scores so far of each of ``n`` queries: a row below them can't be among the query's best ``k`` of all rows, so it is left out of what a task hands on."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores = k, np.full((k, n), -np.inf)

    def offered(self, scores: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(rows, queries) of a block of ``scores`` (rows by queries; rows in the order that settles ties) that may be among the best; only scores above ``floor``."""
        k = min(self.k, len(scores))
        first = np.argsort(-scores, axis=0, kind="stable")[:k]
        top = np.take_along_axis(scores, first, axis=0)
        self.scores = np.sort(np.vstack([self.scores, top]), axis=0)[-self.k :]
        place, query = np.nonzero((top >= self.scores[0]) & (top > floor))
        return first[place, query], query
