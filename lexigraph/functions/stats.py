"""Statistics as column expressions, and tail probabilities in plain Python for the few scalars that need one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.operators.order import running


def average_rank(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank with the mean of tied places. A global rank (no `by`) is a running sum over the counts of distinct values, by ranges of them."""
    if by:
        w, ties = Window.partitionBy(*by).orderBy(col), Window.partitionBy(*by, col)
        return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, [col], _upto=F.col("_n")).select(F.col(col).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, df[col].eqNullSafe(ranks["_v"])).drop("_v")


def safe_corr(a: str, b: str) -> Column:
    """Pearson's r, 0 where either side is constant."""
    n, sa, sb = F.count(F.lit(1)), F.sum(a), F.sum(b)
    num = n * F.sum(F.col(a) * F.col(b)) - sa * sb
    den = F.sqrt(F.greatest(F.lit(0.0), n * F.sum(F.col(a) * F.col(a)) - sa * sa)) * F.sqrt(F.greatest(F.lit(0.0), n * F.sum(F.col(b) * F.col(b)) - sb * sb))
    return F.when(den < 1e-9, F.lit(0.0)).otherwise(F.try_divide(num.cast("double"), den))


def entropy(p: Column, base: str = "ln") -> Column:
    log = F.ln(p) if base == "ln" else F.log2(p)
    return -F.sum(F.when(p > 0, p * log).otherwise(F.lit(0.0)))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def t_tail(t: float, dof: float) -> float:
    """Two-sided."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail, by series or continued fraction."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * front
