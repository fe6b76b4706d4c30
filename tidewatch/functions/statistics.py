"""Scalar statistics: the Kolmogorov-Smirnov p-value, one value per scored feature.

Small samples need the exact two-sample distribution (Hodges 1958; Viehmann 2021 for the
stable recursion). Larger ones use the one-sample distribution of the effective sample size
(Marsaglia, Tsang & Wang 2003; Pelz & Good 1976; Simard & L'Ecuyer 2011).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these functions with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the exact two-sample distribution is used up to this sample size.
EXACT_KS_ROWS = 10_000


def exact_two_sample_p(statistic: float, n: int, m: int) -> float:
    """P(D >= statistic) for samples of n and m rows, all orderings equally likely.

    Walks the lattice of orderings diagonal by diagonal. ``reached[i]`` is the share of the
    paths to (i, s - i) that have left the band, which avoids subtracting from 1.
    """
    common = math.gcd(n, m)
    up, right = m // common, n // common
    limit = round(statistic * up * n)
    if limit == 0:
        return 1.0
    # Outside the band every path has left it, so only cells inside are computed.
    reached = np.ones(n + 1)
    reached[0] = 0.0
    for s in range(1, n + m + 1):
        low = (s * right - limit) // (up + right) + 1
        high = -((-s * right - limit) // (up + right)) - 1
        low, high = max(low, 0, s - m), min(high, n, s)
        i = np.arange(low, high + 1)
        from_left = reached[i - 1] * i
        step = (from_left + reached[i] * (s - i)) / s
        reached[max(low - 2, 0) : high + 1] = 1.0
        reached[i] = step
    return float(min(1.0, max(0.0, reached[n])))


def _one_sided_tail(n: int, d: float) -> float:
    """P(D+ >= d), exact sum; above a million rows its limit form.

    The limit form's relative error is of the order 1/sqrt(n), below 0.2 % from there on.
    """
    if n > 1_000_000:
        return math.exp(-((6 * n * d + 1) ** 2) / (18.0 * n))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    j = np.arange(0, int(math.floor(n * (1 - d))) + 1, dtype=float)
    rest = 1 - d - j / n
    j, rest = j[rest > 0], rest[rest > 0]
    logs = (
        math.lgamma(n + 1)
        - lgamma(j + 1)
        - lgamma(n - j + 1)
        + (j - 1) * np.log(d + j / n)
        + (n - j) * np.log(rest)
    )
    return float(d * np.exp(logs).sum())


def _matrix_cdf(n: int, d: float) -> float:
    """P(D < d) by powers of the transition matrix, exact for small n."""
    k = math.ceil(n * d)
    size, h = 2 * k - 1, k - n * d
    matrix = np.tril(np.ones((size, size)), 1)
    power = np.arange(1, size + 1)
    matrix[:, 0] -= h**power
    matrix[-1, :] -= h ** power[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** size
    row, col = np.indices((size, size))
    steps = np.clip(row - col + 1, 0, None)
    matrix /= np.vectorize(math.factorial, otypes=[float])(steps)
    result, exponent = np.eye(size), 0
    square, square_exponent, left = matrix, 0, n
    while left:
        if left & 1:
            result, exponent = result @ square, exponent + square_exponent
        square, square_exponent = square @ square, 2 * square_exponent
        if square.max() > 1e140:
            square, square_exponent = square * 1e-140, square_exponent + 140
        if result.max() > 1e140:
            result, exponent = result * 1e-140, exponent + 140
        left >>= 1
    value = math.log(result[k - 1, k - 1]) + exponent * math.log(10)
    return math.exp(value + math.lgamma(n + 1) - n * math.log(n))


def _expansion_cdf(n: int, d: float) -> float:
    """P(D < d) by the asymptotic series in 1/sqrt(n) up to the third correction."""
    z = math.sqrt(n) * d
    z2, pi2 = z * z, math.pi**2
    half = np.arange(-20, 21) - 0.5
    whole = np.arange(-20, 21, dtype=float)
    q = pi2 * half**2
    w = pi2 * whole**2
    eq, ew = np.exp(-q / (2 * z2)), np.exp(-w / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = root / z * eq.sum()
    k1 = root / (6 * z**4) * ((q - z2) * eq).sum()
    k2 = root / (72 * z**7) * (
        (6 * z**6 + 2 * z**4 + q * (2 * z**4 - 5 * z2) + q**2 * (1 - 2 * z2)) * eq
    ).sum() - root / (36 * z**3) * (w * ew).sum()
    k3 = root / (6480 * z**10) * (
        (
            q**3 * (5 - 30 * z2)
            + q**2 * (-60 * z2 + 212 * z**4)
            + q * (135 * z**4 - 96 * z**6)
            - 30 * z**6
            - 90 * z**8
        )
        * eq
    ).sum() + root / (108 * z**6) * ((-(w**2) + 3 * w * z2) * ew).sum()
    return k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5


def one_sample_p(n: int, d: float) -> float:
    """P(D >= d) for one sample of n rows."""
    if n * d <= 0.5:
        return 1.0
    if d >= 1 or n * d * d > 370:  # beyond this the tail is below the smallest double
        return 0.0
    if n * d * d >= 2.2:
        tail = 2 * _one_sided_tail(n, d)
    elif n <= 140:
        tail = 1 - _matrix_cdf(n, d)
    else:
        tail = 1 - _expansion_cdf(n, d)
    return min(1.0, max(0.0, tail))


#: How a p-value is found: ``exact``, ``asymptotic``, or by sample size (``auto``).
METHODS = ("auto", "exact", "asymptotic")


def two_sample_p(statistic: float, n: int, m: int, method: str = "auto") -> float:
    if method == "exact" or (method == "auto" and max(n, m) <= EXACT_KS_ROWS):
        return exact_two_sample_p(statistic, n, m)
    return one_sample_p(max(1, round(n * m / (n + m))), statistic)


def ks_p_value(statistic: Column, n: Column, m: Column, method: str = "auto") -> Column:
    """Two-sided p-value; call it on rows that are already one per feature.

    ``auto`` changes from the exact distribution to the asymptotic one above EXACT_KS_ROWS, as
    statistics libraries do by default; the other two methods hold for any size. The exact one
    takes time in proportion to the square of the rows.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")

    def p_values(statistic, n, m):
        return pd.Series(
            [
                two_sample_p(float(d), int(a), int(b), method) if pd.notna(d) and a > 0 and b > 0 else None
                for d, a, b in zip(statistic, n, m)
            ],
            dtype="float64",
        )

    return F.pandas_udf(p_values, DoubleType())(statistic, n, m)
