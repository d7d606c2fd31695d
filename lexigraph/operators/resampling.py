"""Bootstrap fits without resampled rows: a row's number of copies in a replicate is a Poisson draw by its key, so moments of all replicates come from one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectral import added


def mixed(keys: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each key."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def copies(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) numbers, a row a key and a column a replicate; the same on any cluster."""
    draws = mixed(mixed(keys)[:, None] ^ mixed(np.arange(replicates) + 1)) / 2.0**64
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(14)])
    return np.searchsorted(steps, draws, side="right").astype(float)


def chebyshev(x: np.ndarray, degree: int, lo: float, hi: float) -> np.ndarray:
    return np.polynomial.chebyshev.chebvander((2 * x - lo - hi) / max(hi - lo, 1e-300), degree)


def bias_variance(train: DataFrame, test: DataFrame, degrees: list[int], replicates: int, alpha: float = 1e-9, key: str = "id", x: str = "x", y: str = "y") -> list[tuple[int, float, float, float]]:
    """(degree, squared bias, variance, squared error) of polynomial fits over bootstrap replicates of train, measured against the y of test; all of both are read, once for the bounds, once for the fits, once for the errors.

    In the Chebyshev basis a product of two terms is the mean of two others, so the normal equations of every degree need 2 degree + 1 sums of terms and degree + 1 of terms times y a replicate. alpha is a ridge on all but the constant term, as a
    share of the rows. Rows with a null are left out; without rows there is no result; a replicate without rows fits 0."""
    clean = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    train, test, top = clean(train), clean(test), max(degrees)
    lo, hi = train.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return []

    def arrays(batches):
        for b in batches:
            yield (b.column(k).to_numpy() for k in range(3))

    width = 3 * top + 2

    def moments(batches):
        total = np.zeros((replicates, width))
        for ids, xs, ys in arrays(batches):
            w, t = copies(ids, replicates), chebyshev(xs, 2 * top, lo, hi)
            total[:, : 2 * top + 1] += w.T @ t
            total[:, 2 * top + 1 :] += w.T @ (t[:, : top + 1] * ys[:, None])
        return total.ravel()

    sums = added(train, moments, replicates * width).reshape(replicates, width)
    i, j = np.indices((top + 1, top + 1))
    fits = {}
    for d in degrees:
        fits[d] = np.zeros((d + 1, replicates))
        for b in range(replicates):
            s, r = sums[b, : 2 * top + 1], sums[b, 2 * top + 1 :]
            if s[0] > 0:
                gram = ((s[i + j] + s[np.abs(i - j)]) / 2)[: d + 1, : d + 1] + alpha * s[0] * np.diag([0.0] + [1.0] * d)
                fits[d][:, b] = np.linalg.lstsq(gram, r[: d + 1], rcond=None)[0]

    def errors(batches):
        total = np.zeros((len(degrees), 4))
        for _, xs, ys in arrays(batches):
            t = chebyshev(xs, top, lo, hi)
            for k, d in enumerate(degrees):
                p = t[:, : d + 1] @ fits[d]
                total[k] += len(xs), ((p.mean(1) - ys) ** 2).sum(), p.var(1).sum(), ((p - ys[:, None]) ** 2).mean(1).sum()
        return total.ravel()

    out = added(test, errors, 4 * len(degrees)).reshape(-1, 4)
    return [(d, *(float(v) for v in row[1:] / row[0])) for d, row in zip(degrees, out, strict=True) if row[0]]
