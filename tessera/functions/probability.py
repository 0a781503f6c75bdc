"""Tail probabilities Spark has no function for, as Arrow functions over small results.

They run on one row per (column, group), after everything large has been aggregated.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (f - 1.0) / a


def student_two_sided(t: float, df: float) -> float:
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@functools.cache
def _numerator(parts: int) -> tuple[int, list[int]]:
    """L and the coefficients of (1 - q**L)**(parts + 1) / ((1 - q) (1 - q)(1 - q**2)...(1 - q**parts)), L a multiple of 1..parts."""
    period, made = math.lcm(*range(1, parts + 1)), [1]
    for step in (1, *range(1, parts + 1)):
        longer = [0] * (len(made) + period - step)
        for t in range(len(longer)):  # times 1 + q**step + ... + q**(period - step)
            longer[t] = (made[t] if t < len(made) else 0) + (longer[t - step] if t >= step else 0) - (made[t - period] if 0 <= t - period < len(made) else 0)
        made = longer
    return period, made


def _partitions_up_to(total: int, parts: int) -> int:
    """How many partitions into at most ``parts`` parts the numbers 0..total have together, exactly."""
    if total < 0:
        return 0
    period, numerator = _numerator(parts)
    return sum(
        numerator[t] * math.comb((total - t) // period + parts, parts) for t in range(total % period, min(total + 1, len(numerator)), period)
    )


def exact_rank_sum_two_sided(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, from the exact null distribution, in whole numbers.

    The arrangements with U = t are the partitions of t into at most n parts of at most m, n the smaller sample.  Parts that are too
    large are taken out by inclusion and exclusion, so the work depends on the smaller sample alone.
    """
    n, m = sorted((n1, n2))
    low = math.floor(min(u, n1 * n2 - u) + 1e-9)
    if n == 0:
        return 1.0
    taken = [(0, 1)]
    for i in range(1, n + 1):
        taken += [(shift + m + i, -sign) for shift, sign in taken]
    tail = sum(sign * _partitions_up_to(low - shift, n) for shift, sign in taken if shift <= low)
    return float(min(Fraction(1), Fraction(2 * tail, math.comb(n1 + n2, n))))


@F.pandas_udf(DoubleType())
def welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    return pd.Series(
        [student_two_sided(a, b) if k else None for a, b, k in zip(t, df, ok)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series) -> pd.Series:
    """Exact for a small tie-free sample, else normal with tie and continuity correction."""
    out = []
    for ui, a, b, ti in zip(u, n1, n2, tie):
        if pd.isna(ui):
            out.append(None)
            continue
        if min(a, b) <= 8 and ti == 0:
            out.append(exact_rank_sum_two_sided(float(ui), int(a), int(b)))
            continue
        a, b, n = float(a), float(b), float(a + b)
        var = a * b / 12.0 * ((n + 1.0) - ti / (n * (n - 1.0)))
        if var <= 0:
            out.append(1.0)
            continue
        z = (max(ui, a * b - ui) - a * b / 2.0 - 0.5) / math.sqrt(var)
        out.append(min(1.0, math.erfc(z / math.sqrt(2.0))))
    return pd.Series(out, dtype="float64")
