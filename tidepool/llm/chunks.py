"""Word-wise caching of pre-token results, exact with respect to encoding the whole text.

The pre-token pattern never joins what stands before a space to what follows it when that space is
followed by something other than white space: the space opens the next pre-token, also when it ends a longer
stretch of white space. So a text may be cut before every such space, and each " word" piece has the
same pre-tokens alone as in the text; white space before the cut stays at the end of the piece before.
"""
from __future__ import annotations

import re
from collections.abc import Callable

#: Longer pieces are encoded but not kept.
KEEP_CHARS = 64
_CUT = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at every space before something else than white space; that space is left out."""
    parts = text.split(" ")
    for p in parts[1:]:
        if not p or p[0].isspace():
            return _CUT.split(text)
    return parts


class Cache:
    """Values of " word" pieces: a fixed tier of frequent ones and a bounded tier of those met since."""

    def __init__(self, many: Callable[[list[str]], list], frequent: dict | None = None, most: int = 800_000):
        self.many, self.frequent, self.most = many, frequent or {}, most
        self.known = dict(self.frequent)

    def fill(self, cut: list[list[str]]) -> list[str]:
        """Makes every piece of these texts known; the result names those to forget afterwards."""
        need = set()
        for parts in cut:
            need.update(parts[1:])
        missing = need - self.known.keys()
        if len(self.known) + len(missing) > self.most + len(self.frequent):
            self.known = dict(self.frequent)
            missing = need - self.known.keys()
        new = list(missing)
        if new:
            self.known.update(zip(new, self.many([" " + p for p in new]), strict=True))
        return [p for p in new if len(p) > KEEP_CHARS]

    def forget(self, names: list[str]) -> None:
        for p in names:
            self.known.pop(p, None)
