"""Matching blocks of two texts: longest common block first, then both sides of it.

The longest common block is found by walking one text through the suffix automaton of the
other, so its cost is linear in their lengths. Bounds on the characters that blocks can match
come first and during the search, and end it where a pair cannot pass the asked ratio any more.
"""

from __future__ import annotations

import numpy as np


class Automaton:
    """Suffix automaton of a text; ``first`` is where the first occurrence of a state's substrings ends."""

    __slots__ = ("first", "length", "link", "next")

    def __init__(self, text: str):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        nexts, link, length, first, last = self.next, self.link, self.length, self.first, 0
        for i, c in enumerate(text):
            new = len(nexts)
            nexts.append({})
            length.append(i + 1)
            first.append(i)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    link[q] = link[new] = clone
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = new

    def longest(self, text: str) -> tuple[int, int, int]:
        """(start in ``text``, start in the automaton's text, length) of the longest common block, the
        first in ``text`` and then the first in the other; length 0 where there is none."""
        nexts, link, length = self.next, self.link, self.length
        state = n = best = at = where = 0
        for i, c in enumerate(text):
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                n += 1
                if n > best:
                    best, at, where = n, i, state
        return (at - best + 1, self.first[where] - best + 1, best) if best else (0, 0, 0)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def most(a: str, b: str) -> float:
    """An upper bound on the characters that matching blocks of ``a`` and ``b`` can cover.

    They are in both multisets of characters. Blocks of M characters hold M - k common pairs of
    neighbours if there are k blocks, and between two blocks a character of either text is left
    over, so k <= len(a) + len(b) - 2 M + 1; together 3 M <= pairs + len(a) + len(b) + 1.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (a, b))
    pairs = _common(x[1:] << np.uint64(32) | x[:-1], y[1:] << np.uint64(32) | y[:-1])
    return min(_common(x, y), (pairs + len(a) + len(b) + 1) / 3)


def ratio(a: str, b: str, above: float = -1.0) -> float | None:
    """2 * M / (len(a) + len(b)) with M the characters in matching blocks, 1.0 for two empty texts;
    None where the ratio is not above ``above``."""
    total = len(a) + len(b)
    if not total:
        return 1.0 if above < 1 else None
    passes = lambda m: 2.0 * m / total > above
    if above >= 0 and not (passes(min(len(a), len(b))) and passes(most(a, b))):
        return None
    if len(a) and a in b:
        matched = len(a)
    elif len(b) and b in a:
        matched = len(b)
    else:
        matched, left, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
        while todo:
            if not passes(matched + left):
                return None
            i, j, k, m = todo.pop()
            left -= min(j - i, m - k)
            x, y, n = Automaton(b[k:m]).longest(a[i:j])
            if n:
                matched += n
                for part in ((i, i + x, k, k + y), (i + x + n, j, k + y + n, m)):
                    if size := min(part[1] - part[0], part[3] - part[2]):
                        left += size
                        todo.append(part)
    return 2.0 * matched / total if passes(matched) else None
