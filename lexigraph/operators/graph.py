"""Operators on undirected weighted graphs given as nodes(id) and edges(src, dst, weight), src < dst.

Counts, degrees, modularity, clustering and components are plans over the edge table. Shortest paths (1024 sources at a time) and betweenness (a source at a time, its nodes as arrays) run over
packed neighbours that are broadcast and whose size is checked (a graph past `most_edges` is refused there, as both are quadratic anyway). Sources are dealt in equal shares to a few tasks a core, whatever partitions the
nodes have; Louvain moves nodes in rounds on the driver under a like check.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), F.col("weight")))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(m).select("n_nodes", "n_edges", F.coalesce(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)).alias("density"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, w_degree), 0 for nodes without an edge."""
    d = both(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("w_degree"))
    return nodes.select("id").join(d, "id", "left").na.fill(0, ["degree"]).na.fill(0.0, ["w_degree"])


def triangles(edges: DataFrame) -> DataFrame:
    """(id, n): triangles at each node. Edges point from the smaller to the larger degree, which bounds the wedges of a hub."""
    deg = both(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("src", "dst").join(deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    found = wedge.join(closed, ["b", "c"])
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cc): local clustering coefficient, 0 below degree 2."""
    d = degrees(nodes, edges).join(triangles(edges), "id", "left").na.fill(0, ["n"])
    return d.select("id", F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(F.try_divide(2.0 * F.col("n"), F.col("degree") * (F.col("degree") - 1))).alias("cc"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weighted modularity of labels(id, label): sum of L_c / m - (k_c / 2 m)^2."""
    s = labels.select(F.col("id").alias("src"), F.col("label").alias("a"))
    t = labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    e = edges.join(s, "src").join(t, "dst")
    inside = e.where("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("l"))
    k = e.select(F.col("a").alias("label"), "weight").union(e.select("b", "weight")).groupBy("label").agg(F.sum("weight").alias("k"))
    m = edges.agg(F.sum("weight").alias("m"))
    per = k.join(inside, "label", "left").na.fill(0.0, ["l"]).crossJoin(F.broadcast(m))
    return per.agg(F.sum(F.col("l") / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2).alias("modularity"))


def cross_fraction(edges: DataFrame, labels: DataFrame) -> DataFrame:
    s = labels.select(F.col("id").alias("src"), F.col("label").alias("a"))
    t = labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(s, "src").join(t, "dst").agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("cross_fraction"))


def packed(nodes: DataFrame, edges: DataFrame, most_edges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and of each its neighbours: where they begin, their places, the weights. Loops go; of repeated edges one stays."""
    e = edges.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst")), F.col("weight").cast("double").alias("weight")).where("src is not null and dst is not null").limit(most_edges + 1).toArrow()
    if len(e) > most_edges:
        raise ValueError(f"over {most_edges} edges; take components or a subgraph first")
    s, t, w = (e[c].to_numpy() for c in ("src", "dst", "weight"))
    ids = np.unique(np.concatenate([nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").toArrow()["id"].to_numpy(), s, t]))
    s, t = np.searchsorted(ids, s), np.searchsorted(ids, t)
    key, at = np.unique(np.r_[s, t][np.r_[s != t, s != t]] * len(ids) + np.r_[t, s][np.r_[s != t, s != t]], return_index=True)
    w = np.r_[w, w][np.r_[s != t, s != t]][at]
    return ids, np.searchsorted(key, np.arange(len(ids) + 1) * len(ids)), (key % max(1, len(ids))).astype(np.int32), w


def dealt(spark, n: int) -> DataFrame:
    """(id): 0 to n - 1, in equal shares to a few tasks a core."""
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))


def hops(ptr: np.ndarray, near: np.ndarray, sources: np.ndarray, gathered: int = 1 << 18):
    """(nodes reached by each number of hops 1, 2, ...) from sources, as arrays of how many of the sources reach each node then. A source is a bit, a front an array of words, and a step the union of the neighbours' words."""
    n, words = len(ptr) - 1, -(-len(sources) // 64)
    front = np.zeros((n, words), np.uint64)
    bit = np.arange(len(sources))
    front[sources, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    seen = front.copy()
    rows = np.flatnonzero(np.diff(ptr))
    # rows by shares of so many neighbours at most, or one row
    cuts = np.unique(np.r_[np.searchsorted(ptr[rows], np.arange(0, ptr[-1], gathered)), len(rows)]) if len(rows) else np.zeros(1, int)
    while True:
        step = np.zeros_like(front)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = ptr[rows[lo]]
            step[rows[lo:hi]] = np.bitwise_or.reduceat(front[near[at : ptr[rows[hi - 1] + 1]]], ptr[rows[lo:hi]] - at, axis=0)
        step &= ~seen
        count = np.bitwise_count(step).sum(axis=1, dtype=np.int64)
        if not count.any():
            return
        yield count
        seen |= step
        front = step


def path_lengths(nodes: DataFrame, edges: DataFrame, most_edges: int = 1 << 24, batch: int = 1024) -> DataFrame:
    """(id, reached, total): nodes reached and the sum of hops to them. As edges have no direction, what is added up is by how many sources a node is reached."""
    ids, ptr, near, _ = packed(nodes, edges, most_edges)
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast((ids, ptr, near))

    def run(batches):
        ids, ptr, near = shared.value
        reached, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for pdf in batches:
            for k in pdf["id"]:
                for h, count in enumerate(hops(ptr, near, np.arange(k * batch, min(len(ids), (k + 1) * batch))), 1):
                    reached += count
                    total += h * count
        yield pd.DataFrame({"id": ids, "reached": reached, "total": total})

    part = dealt(spark, -(-len(ids) // batch)).mapInPandas(run, "id long, reached long, total long").groupBy("id").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"))
    return nodes.select("id").join(part, "id", "left").na.fill(0, ["reached", "total"])


def by_degree(ptr: np.ndarray, near: np.ndarray, far: np.ndarray, wide: int = 24):
    """(order, ptr, tail, near, far, columns, rest): nodes renumbered by falling degree, so those with a k-th neighbour come first and columns[k] is (their k-th neighbours, lengths); rest is (where they begin, neighbours, lengths) of what is past the last column."""
    degree = np.diff(ptr)
    order = np.argsort(-degree, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tail = np.repeat(place, degree)
    by = np.argsort(tail, kind="stable")
    tail, near, far, degree = tail[by], place[near[by]], far[by], degree[order]
    ptr = np.r_[0, np.cumsum(degree)]
    columns = []
    for k in range(min(wide, int(degree.max(initial=0)))):
        at = ptr[: np.count_nonzero(degree > k)] + k
        columns.append((near[at], far[at]))
    over = np.count_nonzero(degree > wide)
    at = np.flatnonzero((tail < over) & (np.arange(len(tail)) - ptr[tail] >= wide))
    return order, ptr, tail, near, far, columns, (ptr[:over] - wide * np.arange(over), near[at], far[at])


def reach(ptr, near, far, columns, rest, s: int, rounds: int = 300) -> np.ndarray | None:
    """Distances from s, None if they are not found in so many rounds. Few nodes that were brought nearer give it on along their links; of many, all nodes look at their neighbours, a column at a time."""
    dist, room = np.full(len(ptr) - 1, np.inf), np.empty(len(ptr) - 1)
    dist[s], front = 0.0, np.array([s])
    for _ in range(rounds):
        if not len(front):
            return dist
        n = ptr[front + 1] - ptr[front]
        if n.sum() < len(near) // 8:
            link = np.arange(n.sum())
            link += np.repeat(ptr[front] - np.cumsum(n) + n, n)
            to, x = near[link], np.repeat(dist[front], n) + far[link]
            less = x < dist[to]
            to = to[less]
            np.minimum.at(dist, to, x[less])
            front = np.unique(to)
        else:
            old = dist.copy()
            for to, w in columns:
                x = room[: len(to)]
                np.take(dist, to, out=x, mode="clip")
                x += w
                np.minimum(dist[: len(to)], x, out=dist[: len(to)])
            first, to, w = rest
            if len(first):
                dist[: len(first)] = np.minimum(dist[: len(first)], np.minimum.reduceat(dist[to] + w, first))
            front = np.flatnonzero(dist < old)
    return None


def loads(ptr, tail, near, far, columns, rest, s: int, slack: float = 1e-12) -> np.ndarray | None:
    """What lies behind each node on shortest paths from s, by shares of its paths; None if distances were not found. Edges must be longer than the slack."""
    dist = reach(ptr, near, far, columns, rest, s)
    if dist is None:
        return None
    n = len(dist)
    limit, before, ways = np.where(dist < np.inf, dist + slack, -1.0), np.full(n, -1), np.zeros(n, np.int32)
    for to, w in columns:
        x = dist[to]
        x += w
        at = np.flatnonzero(x <= limit[: len(to)])
        before[at] = to[at]
        ways[at] += 1
    first, to, w = rest
    if len(first):
        at = np.flatnonzero(dist[to] + w <= np.repeat(limit[: len(first)], np.diff(np.r_[first, len(to)])))
        v = np.searchsorted(first, at, side="right") - 1
        before[v] = to[at]
        np.add.at(ways, v, 1)
    ways[s], before[s] = 0, -1
    v = np.flatnonzero(before >= 0)
    u, several = before[v], bool((ways > 1).any())
    # steps to s along any one way, by doubling
    level = (before >= 0).astype(np.int32)
    up = np.where(before < 0, np.arange(n), before)
    while (more := level[up]).any():
        level = level + more
        up = up[up]
    if several:
        link = np.flatnonzero(dist[near] + far <= limit[tail])
        link = link[tail[link] != s]
        v, u = tail[link], near[link]
        while (late := level[v] <= level[u]).any():
            np.maximum.at(level, v[late], level[u[late]] + 1)
    order = np.argsort(level[v].astype(np.int16) if len(v) and level.max() < 1 << 15 else level[v], kind="stable")
    u, v = u[order], v[order]
    steps = list(itertools.pairwise(np.unique(np.cumsum(np.bincount(level[v], minlength=1))).tolist()))
    paths = np.zeros(n)
    paths[s] = 1.0
    if several:
        for a, b in steps:
            np.add.at(paths, v[a:b], paths[u[a:b]])
    load = np.zeros(n)
    for a, b in reversed(steps):
        share = 1 + load[v[a:b]]
        if several:
            share *= paths[u[a:b]] / paths[v[a:b]]
        np.add.at(load, u[a:b], share)
    load[s] = 0.0
    return load


def searched(links: list, s: int) -> np.ndarray:
    """Like loads, by a heap of nodes, for edges of any length."""
    inf, n = float("inf"), len(links)
    dist, paths, before, done, order = [inf] * n, [0.0] * n, [()] * n, bytearray(n), []
    dist[s], paths[s] = 0.0, 1.0
    heap = [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = 1
        order.append(u)
        for v, w in links[u]:
            x, old = d + w, dist[v]
            if x < old - 1e-12:
                dist[v], paths[v], before[v] = x, paths[u], [u]
                heapq.heappush(heap, (x, v))
            elif x <= old + 1e-12 and not done[v]:
                paths[v] += paths[u]
                before[v].append(u)
    load = [0.0] * n
    for v in reversed(order):
        share = (1 + load[v]) / paths[v]
        for u in before[v]:
            load[u] += paths[u] * share
    load[s] = 0.0
    return np.array(load)


def betweenness(nodes: DataFrame, edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(id, betweenness): Brandes' accumulation over weighted shortest paths, distance 1 - weight, normalised by (n - 1)(n - 2). Graphs with edges of no length, and sources whose paths have hundreds of steps, are searched node by node."""
    ids, ptr, near, weight = packed(nodes, edges, most_edges)
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast((ids, ptr, near, np.maximum(0.0, 1 - weight)))
    n = nodes.count()
    sources = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").toArrow()["id"].to_numpy()
    starts = spark.sparkContext.broadcast(np.searchsorted(ids, sources).astype(np.int32))

    def run(batches):
        ids, ptr, near, far = shared.value
        slow, links = bool(len(far)) and far.min() <= 2e-12, None
        order, *arrays = by_degree(ptr, near, far)
        place = np.argsort(order)
        score = np.zeros(len(ids))
        for pdf in batches:
            for s in starts.value[pdf["id"].to_numpy()].tolist():
                load = None if slow else loads(*arrays, place[s])
                if load is not None:
                    score[order] += load
                    continue
                if links is None:
                    links = [list(zip(near[a:b].tolist(), far[a:b].tolist(), strict=True)) for a, b in itertools.pairwise(ptr.tolist())]
                score += searched(links, s)
        at = np.flatnonzero(score)
        yield pd.DataFrame({"id": ids[at], "b": score[at]})

    part = dealt(spark, len(sources)).mapInPandas(run, "id long, b double").groupBy("id").agg(F.sum("b").alias("b"))
    scale = 1.0 / max(1, (n - 1) * (n - 2))
    return nodes.select("id").join(part, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def louvain(nodes: DataFrame, edges: DataFrame, most_edges: int = 1 << 22, rounds: int = 20) -> DataFrame:
    """(id, label): communities by greedy modularity moves and contraction; nodes are visited in order of id, so the result is fixed."""
    ids, ptr, near, weight = packed(nodes, edges, most_edges)
    ids = ids.tolist()
    member = {i: i for i in ids}
    graph = {i: dict(zip((ids[k] for k in near[a:b]), weight[a:b].tolist(), strict=True)) for i, a, b in zip(ids, ptr, ptr[1:], strict=False)}
    m2 = sum(sum(v.values()) for v in graph.values()) or 1.0
    for _ in range(rounds):
        label = {u: u for u in graph}
        strength = {u: sum(v.values()) for u, v in graph.items()}
        total = dict(strength)
        moved, again = False, True
        while again:
            again = False
            for u in sorted(graph):
                own = label[u]
                total[own] -= strength[u]
                links = defaultdict(float)
                for v, w in graph[u].items():
                    if v != u:
                        links[label[v]] += w
                best, gain = own, links[own] - total[own] * strength[u] / m2
                for c in sorted(links):
                    g = links[c] - total[c] * strength[u] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += strength[u]
                if best != own:
                    label[u], again, moved = best, True, True
        if not moved:
            break
        member = {i: label[c] for i, c in member.items()}
        small = defaultdict(lambda: defaultdict(float))
        for u, vs in graph.items():
            for v, w in vs.items():
                small[label[u]][label[v]] += w
        graph = {u: dict(v) for u, v in small.items()}
    first = {}
    for i in ids:
        first.setdefault(member[i], i)
    rows = [(i, first[member[i]]) for i in ids]
    return nodes.sparkSession.createDataFrame(rows, "id long, label long")


def subgraph(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of degree `least` or more, and the edges among them."""
    kept = degrees(nodes, edges).where(F.col("degree") >= least).select("id")
    e = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, e
