"""Embedding whitening: principal components by a randomised range finder with power passes over all centred rows, then Rayleigh-Ritz.

Rows whose vector is null, or holds a null or non-finite entry, are dropped. Every other entry c becomes x = floor(256 c), a long (values past a long become its ends). Vectors shorter than the
longest one are filled with zeros. The fit list holds each distinct x vector once, so that copies don't weigh; it is found by one grouping with partial aggregates (a third of all rows
in one vector costs a row a task) and written once, as every pass reads it.

A pass multiplies the covariance with a block of d x w numbers: a task adds up A'(A q) over its centred rows A, Spark sums those by cell, and the driver gets d w numbers, whatever the rows.
The finder starts from w = k + oversample random columns. After each pass Rayleigh-Ritz gives the eigenpairs of the block's span, and each of the first k is checked by its
residual |V u - e u|, set against its distance to the other values. Where that fails after the power passes, the block is doubled, up to all d columns, where the span is the whole space and nothing is left to chance.

Components of no variance (up to rounding) can't be whitened and have no rows: a table of equal vectors gives none. Equal eigenvalues have no components of their own; one basis is
chosen, the same for all rows. Null and repeated ids and repeated rows are kept as they are, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, trim

SCALE = 256
#: Rows that are multiplied at a time hold this many numbers.
CELLS = 1 << 19


def scaled(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x): the rows that stay, their entries as longs."""
    v = F.col(vector).cast("array<double>")
    inf = F.lit(float("inf"))
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & good).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(SCALE * c)).alias("x"))


def rows_of(column: pa.Array, d: int):
    """Blocks of the lists as matrices of longs, filled up with zeros."""
    step = max(1, CELLS // max(1, d))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        sizes = pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(sizes), d), np.int64)
        out[np.arange(d) < sizes[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
        yield out


def summed(fit: DataFrame, run, cells: int) -> np.ndarray:
    """Sum over all tasks of what run(matrices of a task) gives: an array of a fixed number of cells. A task gives one row; rows are added up in two steps, so no task and not the driver holds more than a few arrays."""

    def part(batches):
        total = run(m for b in batches for m in b)
        trim()
        yield pa.RecordBatch.from_pydict({"a": pa.array([np.zeros(cells) if total is None else total], pa.list_(pa.float64()))})

    def add(batches):
        total = np.zeros(cells)
        for b in batches:
            for row in b.column(0):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"a": pa.array([total], pa.list_(pa.float64()))})

    few = max(1, math.isqrt(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = fit.mapInArrow(part, "a array<double>")
    for n in (few, 1):
        rows = rows.repartition(n).mapInArrow(add, "a array<double>")
    got = rows.toArrow()["a"]
    return got[0].values.to_numpy().copy() if len(got) else np.zeros(cells)


class Fit:
    """n, exact sums, and the leading components of a table of distinct vectors."""

    def __init__(self, fit: DataFrame, k: int, oversample: int = 8, passes: int = 6, tolerance: float = 1e-11, seed: int = 12):
        self.fit = fit
        d = self.d = fit.agg(F.max(F.size("x"))).first()[0] or 0
        self.n, self.sums, self.most = self.totals()
        self.values, self.vectors, self.trace, self.widths = np.zeros(0), np.zeros((d, 0)), 0.0, []
        if self.n == 0 or d == 0:
            return
        self.mean = np.array([s / self.n for s in self.sums])
        mean, rng = self.mean, np.random.default_rng(seed)
        spread = lambda xs: sum((((x - mean) ** 2).sum(0) for x in xs), np.zeros(d))
        self.trace = float(self.over(spread, d).sum()) / self.n
        if self.trace <= 0:
            return
        width, k = min(d, k + oversample), min(k, d)
        q = np.linalg.qr(rng.standard_normal((d, width)))[0]
        while True:
            done = False
            for _ in range(passes if width < d else 1):
                y = self.times(q)
                t = q.T @ y
                e, w = np.linalg.eigh((t + t.T) / 2)
                e, w = e[::-1], w[:, ::-1]
                u, rest = q @ w, np.linalg.norm(y @ w - (q @ w) * e, axis=0)
                self.widths.append(width)
                # a vector's error is at most its residual over the distance to the next value that the block holds
                gap = [np.delete(np.abs(e - e[j]), j).min(initial=np.inf) for j in range(k)]
                done = width == d or all(rest[j] <= tolerance * min(gap[j], e[0]) for j in range(k) if e[j] > 1e-13 * e[0])
                if done:
                    break
                q = np.linalg.qr(y)[0]
            if done:
                break
            wider = min(d, 2 * width)
            q = np.linalg.qr(np.c_[q, rng.standard_normal((d, wider - width))])[0]
            width = wider
        keep = np.nonzero(e[:k] > d * np.finfo(float).eps * max(e[0], 0))[0]
        u = u[:, keep] / np.linalg.norm(u[:, keep], axis=0)
        self.values, self.vectors = e[keep], u * np.sign(u[np.abs(u).argmax(0), np.arange(len(keep))])

    def totals(self) -> tuple[int, list[int], int]:
        """Rows, sums by dimension, and the largest entry, exact: partial sums are of Python's whole numbers wherever 64 bits might not hold them."""
        d = self.d

        def part(batches):
            n, s, most = 0, [0] * d, 0
            for batch in batches:
                for m in rows_of(batch.column(0), d):
                    top = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
                    add = (m if top * len(m) < 2**62 else m.astype(object)).sum(0)
                    n, s, most = n + len(m), [a + int(b) for a, b in zip(s, add, strict=True)], max(most, top)
            trim()
            if n:
                yield pa.RecordBatch.from_pydict({"i": pa.array([-2, -1, *range(d)], pa.int32()), "a": pa.array([str(v) for v in (n, most, *s)])})

        parts = self.fit.select("x").mapInArrow(part, "i int, a string").withColumn("a", F.col("a").cast("decimal(38,0)"))
        got = {r["i"]: (int(r["s"]), int(r["m"])) for r in parts.groupBy("i").agg(F.sum("a").alias("s"), F.max("a").alias("m")).collect()}
        return got.get(-2, (0, 0))[0], [got.get(i, (0, 0))[0] for i in range(d)], got.get(-1, (0, 0))[1]

    def over(self, run, cells: int) -> np.ndarray:
        d = self.d

        def of(columns):
            return run(m for c in columns for m in rows_of(c, d))

        return summed(self.fit.select("x"), of, cells)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q: one pass."""
        mean, (d, w) = self.mean, q.shape

        def run(xs):
            total = np.zeros((d, w))
            for x in xs:
                a = x - mean
                total += a.T @ (a @ q)
            return total.ravel()

        return self.over(run, d * w).reshape(d, w) / self.n

    def identity_error(self) -> float:
        """The largest entry by which the covariance of the whitened fit list differs from the identity: one more pass, with what is returned, not with the eigenvalues."""
        k, mean, turn = len(self.values), self.mean, self.vectors / np.sqrt(self.values)

        def run(xs):
            total = np.zeros((k + 1, k))
            for x in xs:
                z = (x - mean) @ turn
                total[0] += z.sum(0)
                total[1:] += z.T @ z
            return total.ravel()

        got = self.over(run, (k + 1) * k).reshape(k + 1, k) / self.n
        return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error) for each row that stays and each of the first k components. deviation is the exact sum of (n x - S)^2, null where it is past a long."""
    x = scaled(df, id_col, vector)
    fit = Fit(cut(x.select("x").groupBy("x").agg(F.lit(1).alias("_one")).select("x"), "fit-list"), k, **options)
    kind = df.schema[id_col].dataType.simpleString()
    n, sums, d, count = fit.n, fit.sums, fit.d, len(fit.values)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not count:
        return df.sparkSession.createDataFrame([], schema)
    wrong, turn, explained, mean = fit.identity_error(), fit.vectors / np.sqrt(fit.values), fit.values / fit.trace, fit.mean
    # 64 bits hold every step of a row's sum if they hold the largest: |n x - S| <= n most + |S|
    short = d * (n * fit.most + max(map(abs, sums))) ** 2 < 2**63

    def run(batches):
        s = np.array(sums, np.int64 if short else object)
        for batch in batches:
            at = 0
            for m in rows_of(batch.column(1), d):
                far = ((n * (m if short else m.astype(object)) - s) ** 2).sum(1)
                far = pa.array([int(v) if v < 2**63 else None for v in far], pa.int64())
                z, rows = (m - mean) @ turn, pa.array(np.repeat(np.arange(len(m)), count))
                ids = batch.column(0).slice(at, len(m))
                at += len(m)
                total = len(m) * count
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(np.tile(np.arange(1, count + 1), len(m)), pa.int32()), pa.array(np.full(total, n), pa.int64()), far.take(rows), pa.array(z.ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(total, wrong))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        trim()

    return x.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 4).withColumnRenamed("id", "vec_id")
