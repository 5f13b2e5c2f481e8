"""Upper tails of the chi-square and F distributions, by continued fractions."""

from __future__ import annotations

import math


def _fraction(step, start: float, most: int = 500) -> float:
    """Modified Lentz evaluation of start + a1/(b1 + a2/(b2 + ...)); ``step(i)`` gives (a, b)."""
    f = start or 1e-300
    c, d = f, 0.0
    for i in range(1, most):
        a, b = step(i)
        d = b + a * d or 1e-300
        c = b + a / c or 1e-300
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def chi2_sf(x: float, dof: float) -> float:
    if x <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    return front / _fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 1:
            return 1.0, 1.0
        i -= 1
        m = i // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(step, 0.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
