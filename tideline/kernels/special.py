"""Tail probabilities of Student's t and F by the incomplete beta function, and a test of normality."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + k / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(level: float, df: float) -> float:
    """The t that a share `level` of the distribution lies within, on both sides of 0."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def omnibus(skew: float, kurt: float, n: float) -> float:
    """D'Agostino and Pearson's sum of the squared normal scores of a sample's skewness and kurtosis; NaN for n under 8."""
    if n < 8:
        return math.nan
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / math.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / b**2))
    root = math.cbrt((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))
    z_kurt = (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))
    return z_skew**2 + z_kurt**2
