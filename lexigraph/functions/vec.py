"""Vector expressions over array columns, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; zero or non-finite vectors become zero vectors. The length is bound to a variable, as it would be computed again for each entry."""
    good = lambda n: (n > EPS) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return F.transform(F.array(norm(a)), lambda n: F.when(good(n), F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: F.lit(0.0))))[0]


def scrub(a: Column) -> Column:
    """NaN and infinities become 0."""
    big = F.lit(float("inf"))
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == big), F.lit(0.0)).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_vector(df, keys: list[str], vector: str, out: str):
    """Mean of a vector column by keys: positions are summed as plain aggregates, so partial sums combine before the shuffle."""
    by_pos = df.select(*keys, F.posexplode(vector).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    return by_pos.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(out))
