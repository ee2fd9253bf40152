"""A bounded store of what has been computed for words, shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordStore:
    """Rows of a matrix by word; words that it lacks are computed many at a time. Emptied when it is full."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, words: int = 600_000, chars: int = 20_000_000):
        self.compute, self.width, self.most, self.most_chars = compute, width, words, chars
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))
        self.chars = 0

    def find(self, words: list[str]) -> np.ndarray:
        """The rows of ``words``, in order and with repeats."""
        new = list(set(words).difference(self.index))
        if new:
            if len(self.index) + len(new) > self.most or self.chars > self.most_chars:
                self.clear()
                new = list(set(words))
            n = len(self.index)
            while len(self.rows) < n + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(new)] = self.compute(new)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self.chars += sum(map(len, new))
        return self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def by_text(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums of stretches of ``values`` with these sizes; zero for an empty one."""
    sizes = np.asarray(sizes)
    out = np.zeros((len(sizes), *values.shape[1:]))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out
