"""Special functions in numpy, for pandas functions: digamma, trigamma, incomplete beta, F distribution, differences of log gamma."""

from __future__ import annotations

import math

import numpy as np


def digamma(x):
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x):
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out + 1 / np.where(low, x, 1) ** 2, out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def f_cdf(x: float, d1: float, d2: float) -> float:
    return betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_quantile(p: float, d1: float, d2: float) -> float:
    low, high = 0.0, 1.0
    while f_cdf(high, d1, d2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_cdf(mid, d1, d2) < p else (low, mid)
    return (low + high) / 2


def erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def lgamma_rise(y, r):
    """lgamma(y + r) - lgamma(r) for y >= 0 and r > 0, by Stirling's series beyond 8: large r lose no digits."""
    top, low = y + r, r + 0 * y
    above, below = top.copy(), low.copy()
    for i in range(1, 8):
        above *= top + i
        below *= low + i
    top, low = top + 8, low + 8
    tail = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return y * np.log(top) + (low - 0.5) * np.log1p(y / low) - y + tail(top) - tail(low) - np.log(above / below)
