"""String similarity that Spark has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matching characters within a window, less half the transpositions, rounded down."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    # Places of b by letter, each looked at once: a letter left behind by the window never comes back, so long texts cost no more per letter.
    places: dict[str, list[int]] = {}
    for j in range(m - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    mine, taken = [], []
    for i, c in enumerate(a):
        left = places.get(c)
        while left and left[-1] < i - reach:
            left.pop()
        if left and left[-1] <= i + reach:
            taken.append(left.pop())
            mine.append(c)
    k = len(mine)
    if not k:
        return 0.0
    theirs = [b[j] for j in sorted(taken)]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (k / n + k / m + (k - swaps) / k) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised for up to four equal leading characters, as soon as it exceeds 0.7."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    lead = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        lead += 1
    return score + lead * weight * (1 - score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either side is null."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
