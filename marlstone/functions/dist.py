"""Scalar distribution functions, on the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(p)


def two_sided_p(t: float) -> float:
    """Two-sided normal p-value of a t statistic."""
    return math.nan if t != t else math.erfc(abs(t) / math.sqrt(2))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    # the fraction is evaluated from its tail, deep enough for the argument
    f = 0.0
    for k in range(int(200 + 20 * math.sqrt(a)), 0, -1):
        f = k * (k - a) / (x + 2 * k + 1 - a - f)
    return scale / (x + 1 - a - f)


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else gamma_upper(df / 2, x / 2)


def chi2_cdf(x: float, df: float) -> float:
    return 1 - chi2_sf(x, df)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, its continued fraction evaluated from the tail."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    f = 0.0
    for k in range(400, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
        f = d / (1 + f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * (1 + f))


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def student_t_logpdf(x: float, nu: float) -> float:
    """Of the unstandardised t."""
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(x * x / nu)


def newey_west_auto_lag(n: int) -> int:
    return math.floor(n ** (1 / 3))
