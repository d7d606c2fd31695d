"""Principal components of sparse rows: randomised subspace iteration by partial sums, so rows are never centred, made dense or gathered."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that are multiplied at a time.
STEP = 1 << 16
#: Columns up to which the product of all columns is made, in one pass, and rows of it at a time.
GRAM, GRAM_ROWS = 2048, 1024


def added(rows: DataFrame, run, cells: int) -> np.ndarray:
    """Sum over all tasks of run(batches), an array of a fixed number of cells: a row a task, added up in two steps."""

    def part(batches):
        yield pa.RecordBatch.from_pydict({"a": pa.array([run(batches)], pa.list_(pa.float64()))})

    def add(batches):
        total = np.zeros(cells)
        for b in batches:
            for row in b.column(0):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"a": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(part, "a array<double>")
    for n in (max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), 1):
        sums = sums.repartition(n).mapInArrow(add, "a array<double>")
    got = sums.toArrow()["a"]
    return got[0].values.to_numpy().copy() if len(got) else np.zeros(cells)


def sparse(batch: pa.RecordBatch, at: str, x: str):
    """(row of each entry, its column, its value, rows) of two list columns."""
    lists = batch.column(batch.schema.get_field_index(at))
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(), batch.column(batch.schema.get_field_index(x)).flatten().to_numpy(), len(n)


def times(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """Sparse rows times q; entries stand in the order of rows."""
    out = np.zeros((n, q.shape[1]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(val[:, None] * q[col], first, axis=0)
    return out


def gram(rows: DataFrame, d: int, at: str = "at", x: str = "x") -> np.ndarray:
    """A'A of the rows, in one pass; a task holds d x d numbers and a few rows with all their columns."""

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            row, col, val, n = sparse(b, at, x)
            for lo in range(0, n, GRAM_ROWS):
                k = slice(*np.searchsorted(row, (lo, lo + GRAM_ROWS)))
                m = min(GRAM_ROWS, n - lo)
                dense = np.bincount((row[k] - lo) * d + col[k], val[k], m * d).reshape(m, d)
                total += dense.T @ dense
        return total[np.triu_indices(d)]

    upper = np.zeros((d, d))
    upper[np.triu_indices(d)] = added(rows, run, d * (d + 1) // 2)
    return upper + np.triu(upper, 1).T


def components(rows: DataFrame, d: int, k: int, oversample: int = 10, tolerance: float = 1e-7, seed: int = 7, at: str = "at", x: str = "x") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variances, axes as columns) of rows given by the columns of their entries and the entries. A pass adds up A'(A q) over the rows; A's mean is taken off afterwards, as (A - 1 m)'(A - 1 m) = A'A - n m m'.
    Up to GRAM columns A'A itself is made in one pass. Beyond, block Krylov: each pass multiplies the block that the last one brought, and the whole basis so far gives the eigenpairs, until the first k have residuals within the tolerance of the distance to their neighbours, or the basis spans all
    columns. A pass is as wide as the first, whatever the basis. Signs make an axis's largest loading positive."""

    def first(batches):
        total = np.zeros(d + 1)
        for b in batches:
            _, col, val, n = sparse(b, at, x)
            total[:d] += np.bincount(col, val, d)
            total[d] += n
        return total

    sums = added(rows, first, d + 1)
    n = sums[d]
    if not n or not d:
        return np.zeros(d), np.zeros(0), np.zeros((d, 0))
    mean, k = sums[:d] / n, min(k, d)

    if d <= GRAM:
        e, w = np.linalg.eigh(gram(rows, d, at, x) / n - np.outer(mean, mean))
        u = w[:, ::-1][:, :k]
        return mean, np.maximum(e[::-1][:k], 0), u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])

    def apply(q):
        def run(batches):
            total = np.zeros(q.shape)
            for b in batches:
                row, col, val, m = sparse(b, at, x)
                z = times(row, col, val, m, q)
                for lo in range(0, len(row), STEP):
                    part = slice(lo, lo + STEP)
                    order = np.argsort(col[part], kind="stable")
                    c = col[part][order]
                    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    total[c[starts]] += np.add.reduceat(val[part][order][:, None] * z[row[part][order]], starts, axis=0)
            return total.ravel()

        return added(rows, run, q.size).reshape(q.shape) / n - np.outer(mean, mean @ q)

    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + oversample))))[0]
    while True:
        y = apply(q)
        basis, image = np.c_[basis, q], np.c_[image, y]
        t = basis.T @ image
        e, w = np.linalg.eigh((t + t.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        rest = np.linalg.norm(image @ w[:, :k] - (basis @ w[:, :k]) * e[:k], axis=0)
        gap = [np.abs(np.delete(e, j) - e[j]).min(initial=np.inf) for j in range(k)]
        full = basis.shape[1] == d
        if full or all(rest[j] <= tolerance * min(gap[j], e[0]) for j in range(k) if e[j] > 1e-12 * e[0]):
            u = basis @ w[:, :k]
            return mean, np.maximum(e[:k], 0), u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])
        width = min(q.shape[1], d - basis.shape[1])
        for _ in range(2):  # twice, as one pass leaves rounding along the basis
            y = y - basis @ (basis.T @ y)
        q, r = np.linalg.qr(y)
        weak = np.abs(np.diag(r)) < 1e-10 * max(e[0], 1e-300)
        q[:, weak] = rng.standard_normal((d, int(weak.sum())))
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        q = q[:, :width]


def projected(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, *keep: str, at: str = "at", x: str = "x", out: str = "pc") -> DataFrame:
    """keep and each centred row's coordinates on the axes."""
    spark, shift = rows.sparkSession, mean @ axes
    shared = spark.sparkContext.broadcast(axes)

    def run(batches):
        for b in batches:
            z = times(*sparse(b, at, x), shared.value) - shift
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), lists], [*keep, out])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, at, x).mapInArrow(run, f"{schema}, {out} array<double>")


def tfidf(tokens: DataFrame, id_col: str, term: str, features: int) -> tuple[DataFrame, DataFrame]:
    """(vocabulary (term, df, at), rows (id, at, x)) of the commonest terms, the first of equal ones by name: term frequency times ln((1 + n) / (1 + df)) + 1, rows of length 1, entries by column. Rows without any of the terms have no entries."""
    ids = tokens.select(id_col).distinct()
    w = tokens.where(F.col(term).isNotNull()).groupBy(id_col, term).agg(F.count(F.lit(1)).alias("tf"))
    words = w.groupBy(term).agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), term).limit(features)
    words = tokens.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(map(tuple, words.collect()))], f"`{term}` string, df long, at int")
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    idf: Column = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    x = w.join(F.broadcast(words), term).crossJoin(F.broadcast(n)).select(id_col, "at", (F.col("tf") * idf).alias("x"))
    rows = x.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    rows = ids.join(rows, id_col, "left").select(id_col, F.coalesce(F.col("c")["at"], F.array().cast("array<int>")).alias("at"), F.coalesce(F.transform("c", lambda s: s["x"] / F.col("size")), F.array().cast("array<double>")).alias("x"))
    return words, rows
