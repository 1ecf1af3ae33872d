"""Optimal string alignment distance over code points, for typo-tolerant terms."""

from __future__ import annotations


def auto_edits(term: str) -> int:
    """Edits allowed for a term: none up to two code points, one up to five, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def osa_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours (no part edited twice); ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i] + [0] * len(b), before
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def similarity(distance: int, a: str, b: str) -> float:
    return 1.0 - distance / max(len(a), len(b))
