"""Connected components of an edge table by alternating large and small stars.

No vertex's edges are ever gathered in one task: minima are partial aggregates, and a vertex with very many edges is
split by the skew join. Each round is written to the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.shared import cut, new_path, remove


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one. Null ends and loops are ignored;
    repeated edges count once; no edges give no rows."""
    spark = edges.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    path = new_path(spark, "stars")
    now, before = cut(now.distinct(), "stars", path), None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        to = new_path(spark, "stars")
        now = cut(small.distinct(), "stars", to)
        remove(spark, path)
        path = to
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
