"""Distribution functions for the few test statistics that reach the driver (no scipy here).

Incomplete gamma and beta are evaluated by their standard series and continued fractions
(Abramowitz & Stegun 6.5, 26.5; modified Lentz), quantiles by bracketing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

SQRT2 = math.sqrt(2.0)
Z95 = 1.959963984540054


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / SQRT2)


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / SQRT2)


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def p_two_sided(z: float) -> float:
    return math.erfc(abs(z) / SQRT2)


def _bisect(f, lo: float, hi: float, target: float) -> float:
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if f(mid) < target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    if p > 0.5:
        return -norm_ppf(1 - p)
    x = _bisect(norm_cdf, -40.0, 0.0, p)
    return x


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    if x > a + 1:
        return 1.0 - gamma_q(a, x)
    term = total = 1.0 / a
    k = a
    for _ in range(100000):
        k += 1
        term *= x / k
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x <= a + 1:
        return 1.0 - gamma_p(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c = 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 100000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = tiny if abs(d) < tiny else d
            c = 1 + num / c
            c = tiny if abs(c) < tiny else c
            d = 1 / d
            step = d * c
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2) if x > 0 else 1.0


def chi2_ppf(p: float, df: float) -> float:
    hi = max(10.0, 10 * df)
    while gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    return _bisect(lambda v: gamma_p(df / 2, v / 2), 0.0, hi, p)


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student t."""
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    hi = 10.0
    while 1 - t_sf(hi, df) < p:
        hi *= 2
        if hi > 1e12:
            break
    return _bisect(lambda v: 1 - t_sf(v, df), 0.0, hi, p)


def f_sf(f: float, d1: float, d2: float) -> float:
    if not math.isfinite(f) or f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0 if f <= 0 else float("nan")
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def f_ppf(p: float, d1: float, d2: float) -> float:
    hi = 10.0
    while 1 - f_sf(hi, d1, d2) < p:
        hi *= 2
    return _bisect(lambda v: 1 - f_sf(v, d1, d2), 0.0, hi, p)


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda v: beta_i(a, b, v), 0.0, 1.0, p)


def gamma_ppf(p: float, shape: float, rate: float) -> float:
    return chi2_ppf(p, 2 * shape) / (2 * rate)


def binom_two_sided_half(k: int, n: int) -> float:
    """Exact two-sided binomial test at 1/2."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    tail = beta_i(n - k, k + 1, 0.5)
    return min(1.0, 2 * tail)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range by double Gauss-Legendre quadrature."""
    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(96)
    z = 8 * z
    wz = 8 * wz
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(norm_cdf)

    def range_cdf(w: float) -> float:
        return float(np.sum(wz * k * phi * np.maximum(cdf(z) - cdf(z - w), 0) ** (k - 1)))

    if df > 2000:
        return max(0.0, 1 - range_cdf(q))
    s, ws = np.polynomial.legendre.leggauss(48)
    spread = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-6, 1 - spread), 1 + spread
    s = 0.5 * (hi - lo) * s + 0.5 * (hi + lo)
    ws = 0.5 * (hi - lo) * ws
    ln = (math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
          + (df - 1) * np.log(s) - df * s * s / 2)
    dens = np.exp(ln)
    total = float(np.sum(ws * dens * np.array([range_cdf(q * v) for v in s])))
    return min(1.0, max(0.0, 1 - total / float(np.sum(ws * dens))))


def bh_adjust(p: list[float]) -> list[float]:
    """Benjamini-Hochberg adjusted p-values in input order."""
    m = len(p)
    order = sorted(range(m), key=lambda i: p[i])
    out = [0.0] * m
    best = 1.0
    for pos in range(m - 1, -1, -1):
        i = order[pos]
        best = min(best, p[i] * m / (pos + 1))
        out[i] = best
    return out


# --- column forms ---------------------------------------------------------------------------

def norm_cdf_col(x: Column) -> Column:
    """Standard normal CDF as an expression: Abramowitz & Stegun 7.1.26-type erfc (error < 1.2e-7)."""
    # Chebyshev coefficients of erfc (Numerical approximation by exponentials).
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = F.abs(x) / F.lit(SQRT2)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + F.lit(c)
    half_erfc = F.lit(0.5) * t * F.exp(-z * z + poly)
    return F.when(x >= 0, F.lit(1.0) - half_erfc).otherwise(half_erfc)


def wilson(k: float, n: float, z: float = Z95) -> tuple[float, float, float]:
    """Proportion with its Wilson score interval."""
    if n <= 0:
        return (float("nan"),) * 3
    p = k / n
    denom = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / denom
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return p, max(0.0, mid - half), min(1.0, mid + half)
