"""Tail probabilities in numpy: regularised incomplete beta, and t, F and normal tests from it."""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(v), tiny) * (1 if v > 0 else -1) if (v := 1 - (a + b) * x / (a + 1)) else 1 / tiny
    value = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f >= 0 and d1 > 0 and d2 > 0 else float("nan")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def studentized_range_upper(q: float, k: int, df: float, nodes: int = 64) -> float:
    """P(range / s > q) by Gauss-Legendre quadrature over the standard deviation and the normal range."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(nodes)
    z, wz = 8 * x, 8 * w
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    # s / sigma lies within 10 standard deviations of 1, which narrow as degrees of freedom grow
    wide = 10 / math.sqrt(2 * df)
    low, high = max(0.0, 1 - wide), 1 + wide
    s, ws = low + (x + 1) / 2 * (high - low), w / 2 * (high - low)
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    density = np.exp(log + (df - 1) * np.log(np.maximum(s, 1e-300)) - df * s * s / 2)
    inner = np.array([(k * phi * wz * np.maximum(cdf(z) - cdf(z - q * v), 0) ** (k - 1)).sum() for v in s])
    return float(min(1.0, max(0.0, 1 - (inner * density * ws).sum() / (density * ws).sum())))


#: An exact distribution of U is computed while the product of the group sizes stays within this; it takes half as many numbers.
MOST_EXACT = 50_000_000


def mann_whitney_exact(u: float, na: int, nb: int) -> float:
    """Two-sided p of U for groups without ties: twice the share of arrangements with a U as small, 1 at most.

    The counts are those of the Gaussian binomial coefficient; one factor (1 - q^(large + i)) / (1 - q^i) at a time.
    """
    import numpy as np

    small, large = min(na, nb), max(na, nb)
    least = int(min(u, na * nb - u))
    count = np.zeros(least + 1)
    count[0] = 1
    for i in range(1, small + 1):
        more = count.copy()
        if large + i <= least:
            more[large + i :] -= count[: least + 1 - large - i]
        for first in range(min(i, least + 1)):
            more[first::i] = np.cumsum(more[first::i])
        count = more
    return min(1.0, 2 * float(count.sum()) / math.comb(na + nb, na))
