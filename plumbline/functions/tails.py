"""Tails of the usual test distributions, for single rows of sufficient statistics."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float | None, df: float | None) -> float | None:
    return None if t is None or not df or df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float | None, d1: float | None, d2: float | None) -> float | None:
    return None if f is None or not d1 or not d2 or d2 <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float | None, df: float | None) -> float | None:
    return None if x is None or not df else gamma_sf(df / 2, x / 2)


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_sf(d: float | None, n: int | None) -> float | None:
    """Asymptotic two-sided p-value of a Kolmogorov-Smirnov distance."""
    if d is None or not n:
        return None
    x = d * math.sqrt(n)
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(120):
        mid = (low + high) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def shapiro_wilk(values: list[float]) -> tuple[float | None, float | None]:
    """W and p of at least 3 values, by Royston's 1995 approximation."""
    x = sorted(values)
    n = len(x)
    if n < 3:
        return None, None
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mean = sum(x) / n
    return shapiro_sums(n, sum(v * v for v in m), sum(p * (q - mean) for p, q in zip(m, x, strict=True)), sum((v - mean) ** 2 for v in x), x[0], x[1], x[-2], x[-1])


def shapiro_sums(n: int, mm: float, mx: float, xx: float, low: float, low2: float, high2: float, high: float) -> tuple[float | None, float | None]:
    """W and p of n values from sums over their ranks i: of m_i squared, m_i times the i-th value less the mean, and
    that squared, where m_i is the normal quantile of (i - 3/8) / (n + 1/4); and the two values at each end."""
    if not n or n < 3 or low == high:
        return None, None
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    u, ends, inner = 1 / math.sqrt(n), high - low, high2 - low2
    m1, m2 = normal_quantile((n - 0.375) / (n + 0.25)), normal_quantile((n - 1.375) / (n + 0.25))
    last = poly((m1 / math.sqrt(mm), 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), u)
    if n == 3:
        ax = math.sqrt(0.5) * ends
    elif n <= 5:
        ax = (mx - m1 * ends) / math.sqrt((mm - 2 * m1**2) / (1 - 2 * last**2)) + last * ends
    else:
        second = poly((m2 / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        phi = (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2)
        ax = (mx - m1 * ends - m2 * inner) / math.sqrt(phi) + last * ends + second * inner
    w = min(1.0, ax**2 / xx)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1e-300, 1 - w)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y, mu, sd = -math.log(g - y), poly((0.544, -0.39978, 0.025054, -6.714e-4), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        mu, sd = poly((-1.5861, -0.31082, -0.083751, 0.0038915), ln), math.exp(poly((-0.4803, -0.082676, 0.0030302), ln))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


# The rational functions of algorithm AS 241 (Wichura 1988) for the normal quantile: near the middle, in the
# tails, and far out, each as numerator and denominator, highest power first.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAILS = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """The standard normal's quantiles of an array of chances between 0 and 1, to about 1e-16."""
    ratio = lambda c, r: np.polyval(c[0], r) / np.polyval(c[1], r)
    q = p - 0.5
    out = np.empty_like(q)
    middle = np.abs(q) <= 0.425
    out[middle] = q[middle] * ratio(_MIDDLE, 0.180625 - q[middle] ** 2)
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)[~middle]))
    out[~middle] = np.copysign(np.where(r <= 5, ratio(_TAILS, r - 1.6), ratio(_FAR, r - 5)), q[~middle])
    return out
