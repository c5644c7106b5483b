"""Statistical expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z) for z >= 0 by the five-term polynomial of Abramowitz and Stegun, 7.1.26."""
    x = z / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # Coefficients of the formula.
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return F.lit(0.5) * poly * F.exp(-x * x)


def exact_upper_tail(z: Column) -> Column:
    """The same tail by ``erfc`` in an Arrow batch function, for any z."""

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore")

    return tail(z)


def beta_fraction(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method; the terms of the fraction alternate between two forms.
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_quantile(p: float, df: float) -> float:
    """The quantile of Student's t with ``df`` degrees of freedom, for p of 0.5 or more, by bisection."""
    upper = lambda t: 0.5 * beta_fraction(df / (df + t * t), df / 2, 0.5)
    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - p else (low, mid)
    return (low + high) / 2


def t_half_width(sem: Column, n: Column, level: float) -> Column:
    """Half the width of a t interval from a standard error over n values; null for fewer than two."""

    @F.pandas_udf("double")
    def half(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([t_quantile((1 + level) / 2, m - 1) * x if m > 1 and x == x else None for x, m in zip(s, k, strict=True)], dtype="float64")

    return half(sem, n.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def draw(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A counter-based draw from 0 to n - 1, the same on any partitioning and in other engines."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n
