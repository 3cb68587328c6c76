"""Two-sided p-values, vectorised over the rows of a column batch."""

from __future__ import annotations

from functools import lru_cache
from math import erfc, lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

EXACT = 50  # up to so many differences without ties the distribution is counted out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / fix(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, steps):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / fix(1 + even * d), fix(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / fix(1 + odd * d), fix(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-16):
            break
    log = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(y) + q * np.log1p(-y))
    value = np.where(y <= 0, 0.0, front * h / p)
    return np.where(turn, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution; NaN without degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = (df > 0) & np.isfinite(t)
    d = np.where(ok, df, 1.0)
    p = incomplete_beta(d / 2, 0.5, d / (d + np.where(ok, t, 0.0) ** 2))
    return np.where(ok, p, np.where((df > 0) & np.isinf(t), 0.0, np.nan))


@lru_cache(maxsize=EXACT + 1)
def _rank_sums(n: int) -> np.ndarray:
    """P(W <= w) for w = 0 ... n (n + 1) / 2: subsets of 1 ... n by their sums, counted by dynamic programming."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    return np.cumsum(ways) / 2.0**n


def signed_rank_p(n: int, w: float, ties: float) -> float:
    """P of a smaller signed-rank sum w of n differences; ties is the sum of t^3 - t over tied groups.

    Fewer than two differences: 1. Counted out for n up to EXACT without ties, else by the normal
    approximation with the correction for ties.
    """
    if n < 2:
        return 1.0
    if n <= EXACT and not ties:
        return float(min(1.0, 2 * _rank_sums(n)[int(w)]))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if var <= 0 else float(min(1.0, erfc(abs(w - n * (n + 1) / 4) / sqrt(2 * var))))


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))
    return p.where(p.notna(), None)


@pandas_udf(DoubleType())
def signed_rank_p_value(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b), float(c)) for a, b, c in zip(n.fillna(0), w.fillna(0), ties.fillna(0), strict=True)])
