"""Operators over ordered groups of vectors: similarity pairs, attention windows, runs, rolling coherence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import vec as V
from lexigraph.shared import cut

from . import metric


def numbered(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """(group, id, pos, u): unit vectors with their place in the group from 1."""
    w = W.partitionBy(group).orderBy(order)
    return df.select(F.col(group).alias("g"), F.col(order).alias("id"), F.row_number().over(w).cast("long").alias("pos"), V.unit(V.doubles(F.col(vector))).alias("u"))


def pairs(e: DataFrame, reach: int | None = None) -> DataFrame:
    """(g, id, p, id2, q, sim) for p < q in a group, at most `reach` places apart."""
    b = e.select("g", F.col("id").alias("id2"), F.col("pos").alias("q"), F.col("u").alias("u2"))
    p = e.join(b, "g").where("q > pos")
    if reach:
        p = p.where(F.col("q") <= F.col("pos") + reach)
    return p.select("g", "id", F.col("pos").alias("p"), "id2", "q", V.dot(F.col("u"), F.col("u2")).alias("sim"))


#: Rows of a block, and blocks ahead that a round looks at, at most.
BLOCK, AHEAD = 512, 16


def attention_windows(e: DataFrame, theta: list[float], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """(theta, g, id, pos, window): how many following rows stay similar to the row itself before the first that does not; a similarity is unknown, and breaks nothing, where lengths differ. Each row scans forward: first its own block of rows, then, in rounds that look further
    ahead each time, only rows that no later row has broken for some threshold yet, so the work follows the windows' lengths. A threshold of -1 or less breaks nothing if inclusive. e(g, id, pos from 1, u); null groups are a group."""
    bounds = sorted(set(map(float, theta)))
    tested = [x for x in bounds if x > -1 or not inclusive]
    dealt = cut(e.select("g", "id", "pos", "u", F.floor((F.col("pos") - 1) / block).alias("blk")), "sequence")
    kind = {c: dealt.schema[c].dataType.simpleString() for c in ("g", "id")}
    schema = f"g {kind['g']}, id {kind['id']}, pos long, " + ", ".join(f"b{i} long" for i in range(len(tested)))

    def scan(left, right):
        if not len(left) or not len(right):
            return pa.table({**{c: left[c].slice(0, 0) for c in ("g", "id", "pos")}, **{f"b{i}": pa.array([], pa.int64()) for i in range(len(tested))}})
        right = right.sort_by("q")
        (x, n), (y, m), p, q = metric.matrix(left["u"]), metric.matrix(right["v"]), left["pos"].to_numpy(), right["q"].to_numpy()
        firsts = [[] for _ in tested]
        for lo in range(0, len(p), BLOCK):
            s = metric.cosine((x[lo : lo + BLOCK], n[lo : lo + BLOCK]), (y, m))
            later = q > p[lo : lo + BLOCK, None]
            for i, t in enumerate(tested):
                broken = later & ((s < t) if inclusive else (s <= t))
                firsts[i].append(np.where(broken.any(axis=1), q[broken.argmax(axis=1)], -1))
        cols = {f"b{i}": np.concatenate(f) for i, f in enumerate(firsts)}
        return pa.table({"g": left["g"], "id": left["id"], "pos": left["pos"], **{c: pa.array(v, mask=v < 0) for c, v in cols.items()}})

    # keyed by text, so that null groups meet too
    key = F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit(""))
    targets = dealt.select(key.alias("k"), F.col("blk").alias("to"), F.col("pos").alias("q"), F.col("u").alias("v"))
    first = [F.min(f"b{i}").alias(f"b{i}") for i in range(len(tested))]
    active, lo, reach, rounds = dealt, 0, 1, None
    last = dealt.groupBy("g").agg(F.max("blk").alias("last"), F.max("pos").alias("n"))
    while tested:
        ahead = active.join(last.select(F.col("g").alias("g_"), "last"), F.col("g").eqNullSafe(F.col("g_"))).drop("g_")
        ahead = ahead.withColumn("to", F.explode(F.sequence(F.col("blk") + lo, F.least(F.col("blk") + lo + reach - 1, F.greatest("last", F.col("blk") + lo))))).where("to <= last")
        ahead = ahead.select("g", "id", "pos", "u", key.alias("key"), F.col("to").alias("tgt"))
        met = ahead.groupBy("key", "tgt").cogroup(targets.groupBy("k", "to")).applyInArrow(scan, schema)
        found = cut(met.groupBy("g", "id", "pos").agg(*first), "breaks")
        rounds = found if rounds is None else rounds.union(found)
        lo, reach = lo + reach, min(2 * reach, AHEAD)
        missing = found.where(" or ".join(f"b{i} is null" for i in range(len(tested)))).select(F.col("g").alias("g_"), F.col("pos").alias("p_"))
        still = active.join(missing, F.col("g").eqNullSafe(F.col("g_")) & (F.col("pos") == F.col("p_")), "left_semi")
        still = still.join(last.select(F.col("g").alias("g_"), "last"), F.col("g").eqNullSafe(F.col("g_")) & (F.col("blk") + lo <= F.col("last")), "left_semi")
        active = cut(still, "unbroken")
        if active.isEmpty():
            break
    rows = dealt.select("g", "id", "pos").join(last.select(F.col("g").alias("g_"), "n"), F.col("g").eqNullSafe(F.col("g_"))).drop("g_")
    if tested:
        breaks = rounds.groupBy("g", "pos").agg(*first).withColumnsRenamed({"g": "g_", "pos": "p_"})
        rows = rows.join(breaks, F.col("g").eqNullSafe(F.col("g_")) & (F.col("pos") == F.col("p_")), "left")
    end = lambda x: F.coalesce(F.col(f"b{tested.index(x)}"), F.col("n") + 1) if x in tested else F.col("n") + 1
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("theta"), (end(x) - F.col("pos") - 1).alias("window")) for x in map(float, theta))))
    return rows.select("g", "id", "pos", each.alias("s")).select("s.theta", "g", "id", "pos", "s.window")


def label_runs(df: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """(group, order, label, window): how many following rows have the row's own label without a break. Linear: run ends, no pairs."""
    w = W.partitionBy(group).orderBy(order)
    change = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    changed = df.select(group, order, label, change.alias("__change"), F.row_number().over(w).cast("long").alias("__pos"))
    runs = changed.withColumn("__run", F.sum("__change").over(w))
    return runs.select(group, order, label, (F.max("__pos").over(W.partitionBy(group, "__run")) - F.col("__pos")).alias("window"))


def adjacent(e: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(g, id, pos, sim to the next row); the last row of a group is dropped."""
    w = W.partitionBy("g").orderBy("pos")
    nxt = F.lead("u").over(w)
    return e.select("g", "id", "pos", *(extra or []), "u", nxt.alias("u2")).where("u2 is not null").select("g", "id", "pos", *(extra or []), V.dot(F.col("u"), F.col("u2")).alias("sim"))


def rolling_coherence(e: DataFrame, width: int = 5) -> DataFrame:
    """(g, start, coherence): mean similarity of the pairs within each whole window of `width` rows. Linear: each row meets the width - 1 rows after it by `lead`, and a
    window adds up the similarities k places apart of its first width - k rows, all on one sort by group and place."""
    w = W.partitionBy("g").orderBy("pos")
    ahead = range(1, width)
    met = e.select("g", "pos", F.count(F.lit(1)).over(W.partitionBy("g")).alias("n"), "u", *(F.lead("u", k).over(w).alias(f"u{k}") for k in ahead))
    sims = met.select("g", "pos", "n", *(V.dot(F.col("u"), F.col(f"u{k}")).alias(f"s{k}") for k in ahead))
    frame = lambda k: w.rowsBetween(0, width - 1 - k)
    parts = sims.select("g", F.col("pos").alias("start"), "n", *(F.sum(f"s{k}").over(frame(k)).alias(f"t{k}") for k in ahead), *(F.count(f"s{k}").over(frame(k)).alias(f"c{k}") for k in ahead))
    total, count = (sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in ahead), F.lit(0)) for c in "tc")
    return parts.where(F.col("start") <= F.col("n") - width + 1).select("g", "start", F.try_divide(total.cast("double"), count.cast("double")).alias("coherence"))
