"""Small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, degrees: float = 1.0) -> float:
    """1 - distribution function of chi-square, so that far tails round to 0."""
    if x <= 0:
        return 1.0
    return 1 - math.erf(math.sqrt(x / 2)) if degrees == 1 else 1 - (1 - gamma_q(degrees / 2, x / 2))


def boxcox_lambda(df: DataFrame, column: str = "distance", span: float = 4.0, rounds: int = 6, points: int = 17) -> float:
    """Exponent of largest Box-Cox likelihood: a grid evaluated in one aggregation, refined a few times."""
    lo, hi = -span, span
    log = F.ln(column)
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        power = lambda k: log if abs(k) < 1e-12 else (F.exp(log * k) - 1) / k
        row = df.agg(F.count("*").alias("n"), F.sum(log).alias("s"), *[F.var_pop(power(k)).alias(f"v{i}") for i, k in enumerate(grid)]).first()
        if not row["n"] or not row["v0"]:
            return 1.0
        worth = [(k - 1) * row["s"] - row["n"] / 2 * math.log(row[f"v{i}"]) if row[f"v{i}"] else -math.inf for i, k in enumerate(grid)]
        best = max(range(points), key=worth.__getitem__)
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (lo + hi) / 2
