"""Distribution functions on numpy: regularised incomplete beta and gamma, F, chi-square, t, hypergeometric."""

from __future__ import annotations

import math

import numpy as np

_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000 + 20 * int(math.sqrt(a + b))):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return out
    raise ArithmeticError(f"incomplete beta({a}, {b}) at {x} did not converge")


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_survival(x: float, d1: float, d2: float) -> float:
    """1 - F.cdf(x; d1, d2); 1 at or below 0, 0 at infinity."""
    if not x > 0:
        return 1.0
    return 0.0 if math.isinf(x) else beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def gamma_cdf(a: float, x: float) -> float:
    """The lower regularised incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    out = d
    for i in range(1, 10_000 + 20 * int(math.sqrt(a))):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            return 1.0 - front * out
    raise ArithmeticError(f"incomplete gamma({a}) at {x} did not converge")


def chi2_quantile(p: float, df: float) -> float:
    """The x with chi-square cdf p: bisection from brackets that are doubled until they hold it."""
    if not p > 0:
        return 0.0
    if p >= 1:
        return math.inf
    low, high = 0.0, max(1.0, df)
    while gamma_cdf(df / 2, high / 2) < p and high < 1e300:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_cdf(df / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-13 * high:
            break
    return (low + high) / 2


def hypergeometric_tail(k: int, population: int, marked: int, drawn: int) -> float:
    """P(X >= k) of the hypergeometric distribution."""
    ks = np.arange(k, min(marked, drawn) + 1)
    ks = ks[(drawn - ks) <= population - marked]
    if not len(ks):
        return 0.0 if k > 0 else 1.0

    def choose(n, r):
        return _ln_gamma(np.asarray(n) + 1.0) - _ln_gamma(np.asarray(r) + 1.0) - _ln_gamma(np.asarray(n) - np.asarray(r) + 1.0)

    logs = choose(marked, ks) + choose(population - marked, drawn - ks) - choose(population, drawn)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))
