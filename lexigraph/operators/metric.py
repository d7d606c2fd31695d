"""Exact search of neighbours and pairs by a metric index that skips blocks of rows.

Rows go to the cell of their nearest pivot; pivots are centres of a bounded sample and only decide how much is skipped. In the order of (cell, distance to the pivot) rows are packed into blocks, one table
row each, with the least and greatest distance of the block's rows to every pivot. By the triangle inequality two rows are at least as far apart as the gap between their blocks' ranges at any pivot, and at most as far as the sum of
the ranges' ends; what a score can't reach through that is never computed. Rows that the metric doesn't cover (zero vectors, other lengths, unknown coordinates) have blocks without bounds and meet all others.

Blocks meet in tiles. A side of the table is SIDES tiles as soon as it has some blocks for each and as long as a tile's side is within SIDE_CELLS, and two sides meet in one tile both ways, so a block is shipped at most SIDES times, at any size in between: what is shipped, and the best rows that a tile leaves, grow with the
rows and not with their square. Neighbours: first each run of 16 blocks by itself, whose rows are near each other; the k-th best so far is a block's threshold, and only block pairs whose bound reaches it are multiplied. Which pairs do is found on a tree of ranges (256 children a node), from the root down, so the number of tests follows what survives. Where
vectors have no clusters the bounds cut nothing and what is left is the product of all blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.shared import cut

#: Rows and numbers of a sample that pivots are fitted on, and pivots, at most.
SAMPLE_ROWS, SAMPLE_CELLS, PIVOTS = 8192, 1 << 22, 512
#: Numbers and rows of a block, blocks of a run of near ones as a power of two, children of a node likewise.
BLOCK_CELLS, BLOCK_ROWS, TILE, FAN = 1 << 16, 256, 4, 8
#: Tiles along a side of the table, at most; blocks of a tile's side, at least; its numbers, at most. The last goes first.
SIDES, SIDE_BLOCKS, SIDE_CELLS = 8, 4, 1 << 23
#: By how much a score may pass its bound: rounding of distances, and of scores to nine digits.
SLACK, ROUND = 1e-6, 2e-9


class Metric(NamedTuple):
    score: Callable  # of two blocks (matrix, lengths)
    far: Callable  # distances of rows to pivots
    best: Callable  # the greatest score at this distance or more
    worst: Callable  # the least score at this distance or less
    unit: bool  # whether vectors have length 1


def cosine(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Dot products of unit vectors; NaN where lengths differ."""
    (a, n), (b, m) = x, y
    if len(n) and len(m) and (n == n[0]).all() and (m == n[0]).all():
        return a[:, : n[0]] @ b[:, : n[0]].T
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (a, b))
    return np.where(n[:, None] == m, a @ b.T, np.nan)


def nearness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Less the squared distance over the coordinates that both have, scaled up to all; NaN where they share none."""
    total, there = np.zeros((len(x[0]), len(y[0]))), np.zeros((len(x[0]), len(y[0])))
    if x[0].shape[1] and not np.isnan(x[0]).any() and not np.isnan(y[0]).any():
        for f in range(x[0].shape[1]):
            d = x[0][:, f, None] - y[0][:, f]
            d *= d
            total += d
        return np.negative(total, out=total)
    for f in range(x[0].shape[1]):
        d = (x[0][:, f, None] - y[0][:, f]) ** 2
        there += ~np.isnan(d)
        total += np.nan_to_num(d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(there > 0, -total * (x[0].shape[1] / there), np.nan)


def euclid(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By differences, as squares of large coordinates would cancel."""
    return np.stack([np.sqrt(((x - q) ** 2).sum(1)) for q in p], axis=1) if len(p) else np.zeros((len(x), 0))


ANGLE = Metric(cosine, lambda x, p: np.arccos(np.clip(x @ p.T, -1, 1)), lambda d: np.cos(np.clip(d, 0, np.pi)), lambda d: np.cos(np.clip(d, 0, np.pi)), True)
EUCLID = Metric(nearness, euclid, lambda d: -(d**2), lambda d: -(d**2), False)


def matrix(u: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists of u as rows, filled with zeros where they are shorter, and their lengths. A null in a list is NaN."""
    lists = u.combine_chunks() if isinstance(u, pa.ChunkedArray) else u
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def plain(x: np.ndarray, n: np.ndarray, d: int, unit: bool) -> np.ndarray:
    """Which rows the metric covers."""
    with np.errstate(invalid="ignore"):
        good = (n == d) & np.isfinite(x).all(axis=1)
        return good & (np.abs((x**2).sum(1) - 1) < 1e-6) if unit else good


def centres(x: np.ndarray, m: int, metric: Metric, rounds: int = 4) -> np.ndarray:
    """At most m pivots: the sample's rows farthest from those before, moved to the means of their cells, in an order in which neighbours are near."""
    if not len(x) or not m:
        return x[:0]
    picked, dist = [0], metric.far(x, x[:1])[:, 0]
    while len(picked) < min(m, len(x)) and dist.max() > 1e-6:
        picked.append(int(dist.argmax()))
        dist = np.minimum(dist, metric.far(x, x[picked[-1:]])[:, 0])
    p = x[picked]
    for _ in range(rounds):
        own = metric.far(x, p).argmin(1)
        p = np.stack([x[own == k].mean(0) if (own == k).any() else p[k] for k in range(len(p))])
        if metric.unit:
            size = np.linalg.norm(p, axis=1, keepdims=True)
            p = np.where(size > 1e-9, p / np.maximum(size, 1e-9), x[picked])
    left, chain, apart = set(range(1, len(p))), [0], metric.far(p, p)
    while left:
        chain.append(min(left, key=lambda k: (apart[chain[-1], k], k)))
        left.remove(chain[-1])
    return p[chain]


def float32(a: np.ndarray) -> bytes:
    return a.astype("<f4").tobytes()


class Index:
    """Blocks of the rows of e(id, u, more columns), and of those of a second table `other` with the same columns if only rows of e are to be matched with rows of it."""

    def __init__(self, e: DataFrame, other: DataFrame | None = None, metric: Metric = ANGLE, group: str | None = None, rows: int | None = None):
        spark = e.sparkSession
        self.metric, self.alone, self.group = metric, other is None, group
        e = e.withColumn("_side", F.lit(2 if self.alone else 0))
        e = (e if self.alone else e.unionByName(other.withColumn("_side", F.lit(1)))).where("id is not null")
        self.more = [c for c in e.columns if c not in ("id", "u", "_side")]
        self.kinds = {c: e.schema[c].dataType.simpleString() for c in ["id", *self.more]}
        total, d = e.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()
        d = max(d or 0, 0)
        self.rows = rows or min(BLOCK_ROWS, max(16, BLOCK_CELLS // max(1, d)))
        wanted = min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, d))
        share = int((1 << 20) * min(1.0, wanted / max(1, total)))
        x, n = matrix(e.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < share).select("u").limit(2 * wanted).toArrow()["u"])
        x = x[plain(x, n, d, metric.unit)]
        self.pivots = spark.sparkContext.broadcast(centres(x, min(PIVOTS, max(4, total // (2 * self.rows))), metric))
        self.m, self.d = len(self.pivots.value), d
        # consecutive blocks are neighbours, so a range of rows is dealt to a task whole; small tables are one range
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (self.rows << TILE)))
        keys = [*([group] if group else []), "_cell", "_far", "id"]
        dealt = self.assigned(e).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        packed = cut(self.packed(dealt), "blocks")
        # blocks are numbered through, a range after the other, so no tile is cut short
        task, before, self.n_blocks = F.shiftright("block", 32), {}, 0
        for k, n in packed.groupBy(task.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect():
            before[k], self.n_blocks = self.n_blocks - (k << 32), self.n_blocks + n
        self.blocks = packed if len(before) < 2 else packed.withColumn("block", F.col("block") + F.create_map(*(F.lit(v).cast("long") for kv in before.items() for v in kv))[task])
        self.n_tiles = -(-self.n_blocks >> TILE)
        most = max(1, SIDE_CELLS // (self.rows * max(1, d)))
        self.tile = min(most, max(SIDE_BLOCKS, -(-self.n_blocks // SIDES)))

    def assigned(self, e: DataFrame) -> DataFrame:
        shared, metric, d = self.pivots, self.metric, self.d

        def run(batches):
            p = shared.value
            for b in batches:
                x, n = matrix(b.column(b.schema.get_field_index("u")))
                good = plain(x, n, d, metric.unit)
                cell, far = np.full(len(n), -1, np.int32), np.zeros(len(n))
                if len(p) and good.any():
                    dist = metric.far(x[good], p)
                    cell[good] = dist.argmin(1)
                    far[good] = dist.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "_cell", "_far"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema.fields)
        return e.mapInArrow(run, f"{schema}, _cell int, _far double")

    def packed(self, rows: DataFrame) -> DataFrame:
        """Rows in order, cut into blocks of one side, group and cell. Blocks are numbered by task, so a node of 2^k blocks is block >> k."""
        shared, metric, d, size, more, group = self.pivots, self.metric, self.d, self.rows, self.more, self.group

        def block(number, t):
            p = shared.value
            x, n = matrix(t["u"])
            good = plain(x, n, d, metric.unit)
            if good.all() and len(p):
                dist = metric.far(x, p)
                lo, hi = dist.min(0), dist.max(0)
                lo, hi = lo - SLACK * (1 + lo), hi + SLACK * (1 + hi)
            else:
                lo, hi = np.zeros(len(p)), np.full(len(p), np.inf)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), t[c].combine_chunks()) for c in ["id", *more]]
            head = [pa.array([number]), pa.array([t["_side"][0].as_py()], pa.int32()), pa.array([len(n)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([float32(lo)], pa.binary()), pa.array([float32(hi)], pa.binary())]
            return pa.RecordBatch.from_arrays([*head, *lists], ["block", "side", "n", "x", "sizes", "lo", "hi", *(f"r_{c}" for c in ["id", *more])])

        def run(batches):
            number, held = TaskContext.get().partitionId() << 32, {}
            for b in batches:
                keys = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ["_side", "_cell", *([group] if group else [])]), strict=True))
                cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    key = keys[lo]
                    for old in [k for k in held if k[1:] != key[1:]]:
                        yield block(number, pa.Table.from_batches(held.pop(old)))
                        number += 1
                    while lo < hi:
                        own = held.setdefault(key, [])
                        take = min(hi - lo, size - sum(map(len, own)))
                        own.append(b.slice(lo, take))
                        lo += take
                        if sum(map(len, own)) == size:
                            yield block(number, pa.Table.from_batches(held.pop(key)))
                            number += 1
            for own in held.values():
                yield block(number, pa.Table.from_batches(own))
                number += 1

        lists = ", ".join(f"`r_{c}` array<{k}>" for c, k in self.kinds.items())
        return rows.mapInArrow(run, f"block long, side int, n int, x binary, sizes array<long>, lo binary, hi binary, {lists}")

    def diagonal(self) -> DataFrame:
        """Pairs (a, b) of blocks of one run of near blocks."""
        one = lambda side, name: self.blocks.where(F.col("side") != side).select(F.shiftright("block", TILE).alias("t"), F.col("block").alias(name))
        pairs = one(1, "a").join(one(0, "b"), "t").select("a", "b")
        return pairs.where("a <= b") if self.alone else pairs

    def close(self, tau: DataFrame | float, far: bool = False, ordered: bool = False) -> DataFrame:
        """Pairs (a, b, bound) of blocks whose best possible score (or, if far, the least one with its sign turned) reaches tau, a number or a table (block, tau). Each pair of a table with itself comes once, or both ways if ordered."""
        m, metric = self.m, self.metric
        leaf = self.blocks.select(F.col("block").alias("node"), "lo", "hi", F.col("side").alias("_s"))
        if isinstance(tau, DataFrame):
            leaf = leaf.join(tau.select(F.col("block").alias("node"), "tau"), "node", "left")
        else:
            leaf = leaf.withColumn("tau", F.lit(float(tau)))
        leaf = leaf.select("node", "lo", "hi", F.when(F.col("_s") == 1, F.lit(float("inf"))).otherwise(F.coalesce("tau", F.lit(-float("inf")))).alias("tau"), (F.col("_s") != 0).alias("hit"))
        schema = "node long, kids binary, los binary, his binary, taus binary, hits binary, lo binary, hi binary, tau double, hit boolean"

        def gather(t):
            t = t.sort_by("node")
            lo, hi = (np.stack([np.frombuffer(v, "<f4") for v in t[c].to_pylist()]) for c in ("lo", "hi"))
            tau, hit = t["tau"].to_numpy(), t["hit"].to_numpy(zero_copy_only=False)
            row = {"node": [t["up"][0].as_py()], "kids": [t["node"].to_numpy().tobytes()], "los": [lo.tobytes()], "his": [hi.tobytes()], "taus": [tau.tobytes()], "hits": [hit.tobytes()], "lo": [float32(lo.min(0))], "hi": [float32(hi.max(0))], "tau": [float(tau.min())], "hit": [bool(hit.any())]}
            return pa.table(row)

        def tests(batches):
            for b in batches:
                out = [[], [], []]
                for p, q in zip(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True), zip(*(b.column(k).to_pylist() for k in range(5, 10)), strict=True), strict=True):
                    (ka, la, ha, ta, _), (kb, lb, hb, _, wb) = p, q
                    ka, kb, ta, wb = np.frombuffer(ka, "<i8"), np.frombuffer(kb, "<i8"), np.frombuffer(ta, "<f8"), np.frombuffer(wb, bool)
                    la, ha, lb, hb = (np.frombuffer(v, "<f4").reshape(len(k), m) for k, v in ((ka, la), (ka, ha), (kb, lb), (kb, hb)))
                    gap, reach = np.zeros((len(ka), len(kb))), np.full((len(ka), len(kb)), np.inf)
                    for k in range(m):
                        if far:
                            np.minimum(reach, ha[:, k, None] + hb[:, k], out=reach)
                        else:
                            np.maximum(gap, np.maximum(la[:, k, None] - hb[:, k], lb[:, k] - ha[:, k, None]), out=gap)
                    bound = -metric.worst(reach) if far else metric.best(gap)
                    keep = (bound >= ta[:, None] - ROUND) & wb
                    if not ordered:
                        keep &= ka[:, None] <= kb
                    i, j = np.nonzero(keep)
                    for o, v in zip(out, (ka[i], kb[j], bound[i, j]), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) if o else pa.array([], t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "bound"])

        levels, now, count = [], leaf, self.n_blocks
        while True:
            last = count <= 1 << FAN
            up = F.lit(0).cast("long") if last else F.shiftright("node", FAN)
            packed = cut(now.withColumn("up", up).groupBy("up").applyInArrow(gather, schema), "nodes")
            levels.append(packed)
            if last:
                break
            now = packed.select("node", "lo", "hi", "tau", "hit")
            count = packed.count()
        pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
        cols = ["kids", "los", "his", "taus", "hits"]
        for packed in reversed(levels):
            side = lambda name, packed=packed: packed.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in cols))
            met = pairs.join(side("a"), "a").join(side("b"), "b").select(*(f"a_{c}" for c in cols), *(f"b_{c}" for c in cols))
            pairs = cut(met.mapInArrow(tests, "a long, b long, bound double"), "block-pairs")
        return pairs

    def run(self, pairs: DataFrame, work: Callable, schema: str, near: bool = False, fold: Callable = pa.concat_tables) -> DataFrame:
        """work(block, blocks to match it with) as Arrow tables for each block a of the pairs, tile by tile, or run by run if all pairs are near; fold makes one table of a tile's, which it takes one by one."""
        side = lambda c: F.shiftright(c, TILE) if near else F.floor(F.col(c) / self.tile)
        tiled = pairs.select("a", "b", F.least(side("a"), side("b")).alias("ta"), F.greatest(side("a"), side("b")).alias("tb"))
        need = tiled.select("ta", "tb", F.explode(F.array("a", "b")).alias("block")).distinct()
        # need holds numbers alone, SIDES for a block of rows at most; by a shuffle the join would ship all blocks once more
        data = self.blocks.drop("lo", "hi").join(F.broadcast(need), "block").withColumnsRenamed({"ta": "ua", "tb": "ub"})
        names = ["id", *self.more]

        def opened(t, at):
            n = t["n"][at].as_py()
            x = np.frombuffer(t["x"][at].as_buffer(), float).reshape(n, -1) if n else np.zeros((0, 0))
            # an item of a list column is a view of its values
            return {"x": (x, np.array(t["sizes"][at].as_py(), np.int64)), "block": t["block"][at].as_py(), **{c: t[f"r_{c}"][at].values for c in names}}

        def tile(left, right):
            at = {k: i for i, k in enumerate(right["block"].to_pylist())}
            partners = {}
            for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
                partners.setdefault(a, []).append(b)
            open_ = {k: opened(right, i) for k, i in at.items()}
            return fold(work(open_[a], [open_[b] for b in sorted(bs)]) for a, bs in sorted(partners.items()))

        return tiled.groupBy("ta", "tb").cogroup(data.groupBy("ua", "ub")).applyInArrow(tile, schema)

    def schema(self, more: str) -> str:
        sides = [f"`{c}_{s}` {self.kinds[c]}" for s in "ij" for c in self.more]
        return ", ".join([f"i {self.kinds['id']}, j {self.kinds['id']}", *sides, more])


def picked(more: list[str], a: dict, b: dict, at: np.ndarray, to: np.ndarray, **scores) -> pa.Table:
    sides = {f"{c}_{s}": t[c].take(pa.array(k)) for s, t, k in (("i", a, at), ("j", b, to)) for c in more}
    return pa.table({"i": a["id"].take(pa.array(at)), "j": b["id"].take(pa.array(to)), **sides, **scores})


def merged(blocks: list[dict], names: list[str]) -> dict:
    """Several blocks as one, in the order of ids."""
    wide = max(b["x"][0].shape[1] for b in blocks)
    x = np.concatenate([np.pad(b["x"][0], ((0, 0), (0, wide - b["x"][0].shape[1]))) for b in blocks])
    cols = {c: pa.concat_arrays([b[c] for b in blocks]) for c in names}
    order = pc.sort_indices(cols["id"])
    k = order.to_numpy()
    return {"x": (x[k], np.concatenate([b["x"][1] for b in blocks])[k]), **{c: v.take(order) for c, v in cols.items()}}


def joined(others: list[dict], names: list[str]):
    """Blocks to match with as few larger ones, those of one run as one. The last is kept with its first block, as the next block of a tile mostly meets the same."""
    for _, run in itertools.groupby(others, lambda o: o["block"] >> TILE):
        run = list(run)
        key = [o["block"] for o in run]
        if run[0].get("_met", (None,))[0] != key:
            run[0]["_met"] = key, merged(run, names)
        yield run[0]["_met"][1]


def alike(one: dict, both: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places (r, c) of the pairs of one id."""
    ids = one["id"].unique()
    own, where = (pc.fill_null(pc.index_in(x["id"], value_set=ids), -1).to_numpy(zero_copy_only=False) for x in (one, both))
    c = np.nonzero(where >= 0)[0]
    r, k = np.nonzero(own[:, None] == where[c])
    return r, c[k]


def known(s: np.ndarray) -> pa.Array:
    return pa.array(s, mask=np.isnan(s))


def firsts(r: np.ndarray, by: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(r, *by, rank): of each r the first k in the order of the last of by, then the one before."""
    order = np.lexsort((*by, r))
    r, by = r[order], [x[order] for x in by]
    rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
    return tuple(x[rank <= k] for x in (r, *by, rank))


def nearest(a: DataFrame, b: DataFrame | None, k: int, metric: Metric = ANGLE, far: bool = False, rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """(i, j, sim, rank, and the other columns as _i and _j): of each row of a the k rows of b (of a itself if None), by another id, of greatest (or least) score; ties of nine digits by id. Unknown scores come last; rows
    without an id are left out. stats gets the numbers of block pairs, and of those that were multiplied."""
    index = Index(a, b, metric, rows=rows)
    more, names = index.more, ["id", *index.more]

    def best(one, others):
        out, limit = [], np.full(len(one["id"]), np.inf)
        for both in joined(others, names):
            s = metric.score(one["x"], both["x"])
            v = s if far else np.negative(s, out=s)
            if np.isnan(v.sum()):
                v[np.isnan(v)] = np.inf
            v[alike(one, both)] = np.nan  # these compare with nothing
            if not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(v, k - 1, axis=1)[:, k - 1] if v.shape[1] >= k else np.inf)
                limit[np.isnan(limit)] = np.inf
            r, c = np.divmod(np.flatnonzero(v <= limit[:, None] + ROUND), v.shape[1])
            key = np.round(v[r, c], 9)
            r, c, key, rank = firsts(r, (c, key), k)
            sim = v[r, c] if far else -v[r, c]
            out.append(picked(more, one, both, r, c, sim=pa.array(sim, mask=np.isinf(sim)), key=key, rank=rank, block=np.full(len(r), one["block"])).append_column("_r", pa.array(r)))
            last = rank == k
            limit[r[last]] = np.minimum(limit[r[last]], key[last])
        t = pa.concat_tables(out)
        if len(out) > 1:
            t = t.take(pc.sort_indices(t, [("_r", "ascending"), ("key", "ascending"), ("j", "ascending")]))
            r = t["_r"].to_numpy()
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            t = t.set_column(t.schema.get_field_index("rank"), "rank", pa.array(rank)).filter(pa.array(rank <= k))
        return t.drop_columns("_r")

    schema = index.schema("sim double, key double, rank long, block long")
    first = index.diagonal()
    if index.alone:
        first = first.union(first.where("a < b").select("b", "a"))
    near = index.run(first, best, schema, near=True)
    if index.n_tiles > 1:
        near = cut(near, "near")
        kth = F.when(F.col("rank") == k, -F.col("key"))
        tau = near.groupBy("block").agg(F.count(kth).alias("c"), F.min(kth).alias("tau")).join(index.blocks.select("block", "n"), "block").where("c >= n").select("block", "tau")
        pairs = index.close(tau, far, ordered=True)
        rest = pairs.where(F.shiftright("a", TILE) != F.shiftright("b", TILE))
        if stats is not None:
            q, t = index.blocks.agg(F.count(F.when(F.col("side") != 1, 1)), F.count(F.when(F.col("side") != 0, 1))).first()
            stats |= {"pairs": q * t, "done": first.count() + rest.count()}
        near = near.union(index.run(rest, best, schema))
    elif stats is not None:
        stats |= {"pairs": first.count(), "done": first.count()}
    place = F.row_number().over(W.partitionBy("i").orderBy("key", "j")).cast("long")
    return near.withColumn("rank", place).where(F.col("rank") <= k).drop("key", "block")


def pair_work(more: list[str], score: Callable, least: float | None, apart: str | None, keep: Callable | None, k: int = 0, floor: float = -np.inf):
    """Pairs i < j of a block and others: above `least` if given, of different values of `apart` if given, and of those only what keep(table) leaves, the best k; none below the floor, which rises with what is kept."""

    def work(one, others):
        out, bar = [], floor
        for other in others:
            s = score(one["x"], other["x"])
            i, j = one["id"], other["id"]
            both = pa.chunked_array([i, j]).combine_chunks() if i.type == j.type else None
            rank = pc.rank(both, tiebreaker="min").to_numpy().astype(np.int64)
            ri, rj = rank[: len(i)], rank[len(i) :]
            ok = ri[:, None] < rj if one["block"] == other["block"] else ri[:, None] != rj
            if least is not None:
                ok &= s > least
            if apart:
                code = pc.index_in(pa.concat_arrays([one[apart], other[apart]]), value_set=pa.concat_arrays([one[apart], other[apart]]).unique()).to_numpy(zero_copy_only=False)
                ok &= code[: len(i), None] != code[len(i) :]
            if keep is not None:
                ok &= s >= bar - ROUND
            r, c = np.nonzero(ok)
            turn = ri[r] > rj[c]
            a = picked(more, one, other, r[~turn], c[~turn], sim=known(s[r, c][~turn]))
            b = picked(more, other, one, c[turn], r[turn], sim=known(s[r, c][turn]))
            out.append(pa.concat_tables([a, b]))
            if keep is not None:
                out = [keep(pa.concat_tables(out))]
                bar = max(bar, out[0]["sim"][k - 1].as_py()) if 0 < k == len(out[0]) else bar
        return pa.concat_tables(out)

    return work


def all_pairs(e: DataFrame, least: float | None = None, apart: str | None = None, rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """(i, j, sim, other columns) for i < j; with `least` only pairs above it, and blocks that can't have one are skipped. Without it the result is quadratic, as the definition is."""
    index = Index(e, rows=rows)
    pairs = index.close(-np.inf if least is None else least)
    if stats is not None:
        stats |= {"pairs": index.n_blocks * (index.n_blocks + 1) // 2, "done": pairs.count()}
    return index.run(pairs, pair_work(index.more, index.metric.score, least, apart, None), index.schema("sim double"))


def top_pairs(e: DataFrame, k: int, apart: str | None = None, rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """The k pairs i < j of greatest sim to nine digits, ties by ids; a block keeps k at most. Tiles on the diagonal give a first threshold, below which block pairs are skipped."""
    index = Index(e, rows=rows)

    def keep(t):
        t = t.filter(pc.is_valid(t["sim"]))
        order = pc.sort_indices(t.append_column("_m", pc.negate(pc.round(t["sim"], 9))), [("_m", "ascending"), ("i", "ascending"), ("j", "ascending")])
        return t.take(order[:k])

    work = lambda floor: pair_work(index.more, index.metric.score, None, apart, keep, k, floor)
    schema = index.schema("sim double")
    ranked = lambda p: p.orderBy(F.desc(F.round("sim", 9)), "i", "j").limit(k)
    first = cut(index.run(index.diagonal(), work(-np.inf), schema, near=True), "first")
    if index.n_tiles == 1:
        return ranked(first)
    found = [r["sim"] for r in ranked(first).select("sim").collect()]
    floor = found[-1] if len(found) == k else -np.inf
    pairs = index.close(floor)
    rest = pairs.where(F.shiftright("a", TILE) != F.shiftright("b", TILE))
    if stats is not None:
        stats |= {"pairs": index.n_blocks * (index.n_blocks + 1) // 2, "done": index.diagonal().count() + rest.count()}
    return ranked(first.union(index.run(rest, work(floor), schema)))


def middle(e: DataFrame, bins: int = 1 << 16, most: int = 1 << 20) -> float | None:
    """The median score of all pairs of different ids, null if none is known. A few rows' pairs give a first bracket; a pass over all pairs counts what lies below the bracket and, within it, by
    bins, whose two middle places are the next bracket (all scores, if they are not within), until it holds at most `most` pairs, which come to the driver as numbers. Scores are quadratic in the rows; none is kept before that."""
    index = Index(e)
    names, score = ["id", *index.more], index.metric.score
    pairs = index.close(-np.inf)

    def sums(ts):
        """Numbers by bin of a tile, added up as they come, so a tile holds one number a bin."""
        total = np.zeros(bins + 2, np.int64)
        for t in ts:
            total += t["n"].to_numpy()
        at = np.flatnonzero(total)
        return pa.table({"bin": np.r_[-1, np.arange(bins + 1)][at], "n": total[at]})

    def scores(one, others):
        """The known scores of a block's own pairs, then of those with others."""
        own = [o for o in others if o["block"] == one["block"]]
        for both in [*own, *joined([o for o in others if o["block"] != one["block"]], names)]:
            s = score(one["x"], both["x"])
            s[alike(one, both)] = np.nan
            if both.get("block") == one["block"]:
                s[np.tril_indices(len(s))] = np.nan
            yield s[np.isfinite(s)] if np.isnan(s.sum()) else s.ravel()

    def passed(lo, hi, values=False):
        """Numbers by bin (-1: below, `bins`: all); or the scores within and the number below."""

        def counted(one, others):
            total = np.zeros(bins + 2, np.int64)
            for s in scores(one, others):
                within = s[(s >= lo) & (s < hi)]
                total[1:-1] += np.bincount(np.minimum(((within - lo) * (bins / (hi - lo))).astype(int), bins - 1), minlength=bins)
                total[[0, -1]] += np.count_nonzero(s < lo), len(s)
            return pa.table({"n": total})

        def valued(one, others):
            below, within = 0, [np.zeros(0)]
            for s in scores(one, others):
                below += np.count_nonzero(s < lo)
                within.append(s[(s >= lo) & (s < hi)])
            v = np.r_[np.nan, np.concatenate(within)]
            return pa.table({"s": v, "n": np.r_[below, np.zeros(len(v) - 1, np.int64)]})

        if values:
            t = index.run(pairs, valued, "s double, n long").toArrow()
            v = t["s"].to_numpy()
            return int(t["n"].to_numpy().sum()), np.sort(v[~np.isnan(v)])
        got = index.run(pairs, counted, "bin long, n long", fold=sums).groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        return dict(zip(got["bin"].to_pylist(), got["n"].to_pylist(), strict=True))

    x, n = matrix(e.where("id is not null").where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(64)) < 16).select("u").limit(1024).toArrow()["u"])
    few = score((x, n), (x, n))[np.triu_indices(len(n), 1)]
    few = few[np.isfinite(few)]
    whole = (-2.0, 2.0)
    lo, hi = np.quantile(few, (0.45, 0.55)) if len(few) > 1000 else whole
    lo, hi = lo - 1e-9, hi + 1e-9
    while True:
        n = passed(lo, hi)
        total, below = n.get(bins, 0), n.get(-1, 0)
        if not total:
            return None
        inside = sorted((b, c) for b, c in n.items() if 0 <= b < bins)
        at = np.cumsum([c for _, c in inside]) + below
        first, last = (total - 1) // 2, total // 2
        if not (len(at) and below <= first and last < at[-1]):
            lo, hi = whole
            continue
        a, b = (int(np.searchsorted(at, k, side="right")) for k in (first, last))
        held, wide = sum(c for _, c in inside[a : b + 1]), (hi - lo) / bins
        # rounding may put a score at an edge on either side
        lo, hi = lo + inside[a][0] * wide - 1e-13, lo + (inside[b][0] + 1) * wide + 1e-13
        if held <= most:
            below, values = passed(lo, hi, values=True)
            return float((values[first - below] + values[last - below]) / 2)
        if hi - lo < 1e-12:
            return float((lo + hi) / 2)


def best_between(e: DataFrame, group: str, rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """(g, h, i, j, sim) for groups g < h: the pair of greatest sim to nine digits, ties by ids. Blocks hold one group; a block of each gives a first threshold for a pair of groups."""
    e = e.where(F.col(group).isNotNull()).withColumnRenamed(group, "grp").select("id", "u", "grp")
    index = Index(e, group="grp", rows=rows)
    more, index_score = index.more, index.metric.score

    def keep(t):
        t = t.filter(pc.is_valid(t["sim"]))
        up = pc.less(t["grp_i"], t["grp_j"])
        side = lambda a, b: pc.if_else(up, t[a], t[b])
        t = pa.table({"g": side("grp_i", "grp_j"), "h": side("grp_j", "grp_i"), "i": side("i", "j"), "j": side("j", "i"), "m": pc.negate(pc.round(t["sim"], 9)), "sim": t["sim"]})
        t = t.take(pc.sort_indices(t, [("g", "ascending"), ("h", "ascending"), ("m", "ascending"), ("i", "ascending"), ("j", "ascending")]))
        firsts = t.append_column("at", pa.array(np.arange(len(t)))).group_by(["g", "h"]).aggregate([("at", "min")])["at_min"]
        return t.take(firsts)

    names = ["id", *index.more]

    def work(one, others):
        out = []
        for _, same in itertools.groupby(sorted(others, key=lambda o: (repr(o["grp"][0].as_py()), o["block"])), lambda o: o["grp"][0].as_py()):
            for both in joined(list(same), names):
                s = index_score(one["x"], both["x"])
                s[alike(one, both)] = np.nan
                top = np.fmax.reduce(s, axis=None, initial=-np.inf)
                r, c = np.nonzero(s >= top - ROUND)  # whatever rounds to the greatest
                out.append(picked(more, one, both, r, c, sim=known(s[r, c])))
        return keep(pa.concat_tables(out))

    kind = index.kinds
    schema = f"g {kind['grp']}, h {kind['grp']}, i {kind['id']}, j {kind['id']}, m double, sim double"
    least: Column = F.min(F.struct("m", "i", "j", "sim")).alias("b")
    own = index.blocks.select("block", F.col("r_grp")[0].alias("grp"))
    first = own.groupBy("grp").agg(F.min("block").alias("block"))
    side = lambda t, b, g: t.select(F.col("block").alias(b), F.col("grp").alias(g))
    begun = side(first, "a", "g").crossJoin(side(first, "b", "h")).where("g < h").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    seen = cut(index.run(begun, work, schema).groupBy("g", "h").agg(least), "first")
    met, floor = seen.agg(F.count("b.m"), F.max("b.m")).first()
    pairs = index.close(-floor if met and met == begun.count() else -np.inf)
    named = pairs.join(side(own, "a", "ga"), "a").join(side(own, "b", "gb"), "b").where("ga != gb")
    known_ = seen.select("g", "h", F.col("b.m").alias("m"))
    rest = named.select("a", "b", "bound", F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h")).join(known_, ["g", "h"], "left").where(F.col("m").isNull() | (F.col("bound") >= -F.col("m") - ROUND))
    if stats is not None:
        stats |= {"pairs": index.n_blocks * (index.n_blocks + 1) // 2, "done": begun.count() + rest.count()}
    return index.run(rest, work, schema).groupBy("g", "h").agg(least).select("g", "h", "b.i", "b.j", "b.sim")
