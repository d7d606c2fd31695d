"""Geometry of groups of vectors: cohesion, dispersion, drift, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import vec as V
from lexigraph.shared import cut

from . import metric


def units(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, more, u) with unit vectors; rows without a vector go."""
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), *more, V.unit(V.doubles(F.col(vector))).alias("u"))


def group_sums(e: DataFrame, group: str) -> DataFrame:
    """(group, n, s): rows and the sum vector of each group."""
    by_pos = e.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return by_pos.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))


def cohesion(e: DataFrame, group: str) -> DataFrame:
    """Mean pairwise cosine of a group from its sum vector alone: (|s|^2 - n) / (n (n - 1)); linear in the rows. Null for one row."""
    g = group_sums(e, group)
    return g.select(group, "n", F.try_divide(V.dot(F.col("s"), F.col("s")) - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("cohesion"))


def dispersion(e: DataFrame, group: str) -> DataFrame:
    """1 less the mean cosine to the group's unit centroid."""
    c = group_sums(e, group).select(group, V.unit(F.col("s")).alias("c"))
    return e.join(c, group).groupBy(group).agg((1 - F.avg(V.dot(F.col("u"), F.col("c")))).alias("dispersion"))


def all_pairs(e: DataFrame, condition=None, least: float | None = None) -> DataFrame:
    """(i, j, sim) for i < j, above `least` only if that is given; rows without an id have no pairs."""
    p = metric.all_pairs(e, least)
    return p if condition is None else p.where(condition)


def pair_sums(e: DataFrame) -> DataFrame:
    """One row (n, total): the number of pairs i < j of different ids and the sum of their cosines, from sums over rows and over ids alone: all ordered pairs are the square of the sum vector, less those of one id."""
    e = e.where("id is not null")
    square = lambda keys: (
        e.select(*keys, F.posexplode("u").alias("p", "x")).groupBy(*keys, "p").agg(F.sum("x").alias("x")).agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("q"))
    )
    count = e.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2, F.lit(0.0)).cast("long").alias("n"))
    return count.crossJoin(square([])).crossJoin(square(["id"]).withColumnRenamed("q", "own")).select("n", ((F.col("q") - F.col("own")) / 2).alias("total"))


def moments(e: DataFrame, by: list[str], x: str, y: str | None = None) -> DataFrame:
    """(by, n, sx, sxx and, with y, sy, syy, sxy): over the pairs of rows of a group, the sums of their dot products of x and of y, and of the squares and products of these; pairs whose lengths differ in x or y are unknown and left out.
    No pairs are made: the squares of all dot products add up to the square of the matrix of sums of products, less each row with itself. A task gives a matrix for each group that it has rows of."""
    cols = [x] if y is None else [x, y]

    def entries(key, held):
        for part, v in held.items():
            v = np.ravel(v)
            yield pa.table({**{k: pa.array([c] * len(v), kinds[k]) for k, c in zip(by, key, strict=False)}, "_sizes": pa.array([",".join(map(str, key[len(by) :]))] * len(v)), "_part": pa.array([part] * len(v)), "_at": np.arange(len(v)), "_v": v.astype(float)})

    kinds = {}

    def run(batches):
        held = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            kinds.update({k: t.schema.field(k).type for k in by})
            vs = [metric.matrix(t[c]) for c in cols]
            keys, at = list(zip(*(t[k].to_pylist() for k in by), *(n.tolist() for _, n in vs), strict=True)), {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, i in at.items():
                own = [m[i][:, :size] for (m, _), size in zip(vs, k[len(by) :], strict=True)]
                a, c = own[0], own[-1]
                qa, qc = (a**2).sum(1), (c**2).sum(1)
                new = {"n": np.array(float(len(i))), "x": a.sum(0), "xx": a.T @ a, "ox": qa.sum(), "oxx": (qa**2).sum()}
                if y is not None:
                    new |= {"y": c.sum(0), "yy": c.T @ c, "xy": a.T @ c, "oy": qc.sum(), "oyy": (qc**2).sum(), "oxy": (qa * qc).sum()}
                old = held.get(k)
                held[k] = new if old is None else {p: v + new[p] for p, v in old.items()}
            if len(held) > 256:  # many groups: those that are over, in the order of rows, are not held
                last = keys[-1]
                for k in [k for k in held if k != last]:
                    for e_ in entries(k, held.pop(k)):
                        yield from e_.to_batches()
        for k, v in held.items():
            for e_ in entries(k, v):
                yield from e_.to_batches()

    schema = ", ".join([*(f"`{k}` {e.schema[k].dataType.simpleString()}" for k in by), "_sizes string, _part string, _at long, _v double"])
    rows = e.select(*by, *cols).where(" and ".join(f"`{c}` is not null" for c in cols))
    if by:
        rows = rows.sortWithinPartitions(*by)
    total = rows.mapInArrow(run, schema).groupBy(*by, "_sizes", "_part", "_at").agg(F.sum("_v").alias("v"))
    part = lambda p, v: F.coalesce(F.sum(F.when(F.col("_part") == p, v)), F.lit(0.0))
    v = F.col("v")
    half = {"n": (part("n", v * v) - part("n", v)) / 2} | {f"s{p}": (part(p, v * v) - part(f"o{p}", v)) / 2 for p in (["x", "xx"] if y is None else ["x", "xx", "y", "yy", "xy"])}
    sized = total.groupBy(*by, "_sizes").agg(*(c.alias(k) for k, c in half.items()))
    return sized.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), *(F.sum(k).alias(k) for k in half if k != "n"))


def pair_moments(e: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """The moments of the pairs of different ids, as one row; a missing one is 0."""
    e = e.where("id is not null")
    again = e.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    own = moments(e.join(again, "id", "left_semi"), ["id"], x, y).drop("id")
    signed = moments(e, [], x, y).withColumn("_sign", F.lit(1)).unionByName(own.withColumn("_sign", F.lit(-1)))
    return signed.agg(*(F.coalesce(F.sum(F.col(c) * F.col("_sign")), F.lit(0)).alias(c) for c in signed.columns if c != "_sign"))


def spread(n, s, ss):
    """Population deviation from a count, a sum and a sum of squares; null for no values."""
    mean = F.try_divide(s, n)
    return F.when(n > 0, F.sqrt(F.greatest(F.try_divide(ss, n) - mean * mean, F.lit(0.0))))


def nearest(a: DataFrame, b: DataFrame | None, k: int, by: metric.Metric = metric.ANGLE, far: bool = False) -> DataFrame:
    """(i, j, sim, rank): of each row of a the k rows of b (a itself if None), by another id, of greatest (or least) score; ties by id."""
    return metric.nearest(a, b, k, by, far)


def cross(a: DataFrame, b: DataFrame, i: str = "i", j: str = "j", digits: int = 6, rows: int = 512) -> DataFrame:
    """(i, j, sim) for all rows of a(id, u) with all rows of b(id, u): products of blocks, whose rows leave a batch at a time; null where lengths differ. As many rows as there are pairs, none of which is held or shuffled."""

    def packed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                ids, u = batch.slice(lo, rows).columns
                x, n = metric.matrix(u)
                lists = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([lists, pa.array([x.tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["id", "x", "n"])

    def products(batches):
        def side(row, at):
            n = row[at + 2][0].values.to_numpy()
            return row[at][0].values, (np.frombuffer(row[at + 1][0].as_buffer(), float).reshape(len(n), -1), n)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).columns
                (p, x), (q, y) = side(row, 0), side(row, 3)
                s = metric.cosine(x, y)
                r = np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits
                r = (np.copysign(r, s) + 0.0).ravel()
                at, to = np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))
                yield pa.RecordBatch.from_arrays([p.take(pa.array(at)), q.take(pa.array(to)), pa.array(r, mask=np.isnan(r))], [i, j, "sim"])

    kind = lambda e: e.schema["id"].dataType.simpleString()
    block = lambda e: cut(e.select("id", "u").mapInArrow(packed, f"id array<{kind(e)}>, x binary, n array<long>"), "cross-blocks")
    left = block(a).withColumnsRenamed({"id": "_id", "x": "_x", "n": "_n"}).repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    return left.crossJoin(block(b).coalesce(1)).mapInArrow(products, f"`{i}` {kind(a)}, `{j}` {kind(b)}, sim double")


def knn(e: DataFrame, k: int, far: bool = False) -> DataFrame:
    """(i, j, sim, rank): the k nearest (or farthest) rows of each row; ties by id."""
    return nearest(e, None, k, far=far)


def knn_graph(e: DataFrame, k: int, mutual: bool = False) -> DataFrame:
    """Undirected edges (src < dst, weight) of the union (or intersection) of the neighbour lists."""
    near = knn(e, k).select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "sim")
    g = near.groupBy("src", "dst").agg(F.max("sim").alias("weight"), F.count(F.lit(1)).alias("ways"))
    return (g.where("ways = 2") if mutual else g).drop("ways")
