"""Similarity of two texts by their longest common substring and, recursively, what lies left and right of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str, needed: float = 0) -> int:
    """Letters in common substrings: the first longest one (by position in a, then in b) and those on either side of it. The count ends where it cannot come to needed any more."""
    total, todo, left = 0, [(a, b)], min(len(a), len(b))
    while todo and total + left >= needed:
        x, y = todo.pop()
        left -= min(len(x), len(y))
        best = at = 0
        for i in range(len(x)):
            while i + best < len(x) and x[i : i + best + 1] in y:
                best, at = best + 1, i
        if not best:
            continue
        bt = y.index(x[at : at + best])
        total += best
        for part in ((x[:at], y[:bt]), (x[at + best :], y[bt + best :])):
            todo.append(part)
            left += min(len(part[0]), len(part[1]))
    return total


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the common letters over all letters; 0 if a side is empty. Below least, any number below it."""
    return 2 * common_length(a, b, least * (len(a) + len(b)) / 2 - 1e-6) / (len(a) + len(b)) if a and b else 0.0


def at_most(a: str, b: str) -> float:
    """A bound of ratio() that is cheap: letters in common in any order."""
    counts: dict[str, int] = {}
    for c in a:
        counts[c] = counts.get(c, 0) + 1
    shared = 0
    for c in b:
        if counts.get(c, 0) > 0:
            counts[c] -= 1
            shared += 1
    return 2 * shared / (len(a) + len(b)) if a and b else 0.0


def title_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """ratio() of two normal titles; pairs that the cheap bound puts below least get 0."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q and p else ratio(p, q) if at_most(p, q) >= least else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)
