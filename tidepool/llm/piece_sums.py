"""Sums of per-piece vectors over whole texts, with the pieces' vectors kept in a bounded worker cache."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np


class PieceSums:
    """vectors(pieces) -> a row of `width` numbers for each; texts are cut at white space into pieces."""

    def __init__(self, vectors: Callable[[list[str]], np.ndarray], width: int, most: int = 500_000):
        self.vectors, self.width, self.most = vectors, width, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def _learn(self, new: list[str]) -> None:
        n = len(self.at)
        if n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), self.width))])
        if new:
            self.rows[n : n + len(new)] = self.vectors(new)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: the sum of its pieces' vectors (zeros for none)."""
        cut = [(x or "").split() for x in texts]
        out = np.zeros((len(texts), self.width))
        need = {p for parts in cut for p in parts}
        new = need - self.at.keys()
        if len(self.at) + len(new) > self.most:
            self._clear()
            new = need
        long = [p for p in new if len(p) > 64]
        self._learn([p for p in new if len(p) <= 64])
        beyond = dict(zip(long, self.vectors(long), strict=True)) if long else {}
        get = self.at.__getitem__
        for i, parts in enumerate(cut):
            if beyond:
                out[i] = sum((beyond[p] for p in parts if p in beyond), np.zeros(self.width))
                parts = [p for p in parts if p not in beyond]
            if parts:
                out[i] += self.rows[np.fromiter(map(get, parts), np.int64, len(parts))].sum(0)
        return out
