"""Places and running sums over a whole table in one order, without a task that holds it all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.shared import cut


def running(df: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of its column over the rows up to this one in the order of keys. Rows are dealt by ranges of keys; each range sums its own rows and
    adds the totals of the ranges before it, one row a range. Ties of all keys are in no fixed order and share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.withColumns(sums).repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    within = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums))
    before = totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = dealt.withColumns({c: F.sum(c).over(within) for c in sums}).join(F.broadcast(before), "_range")
    return inside.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).select(*df.columns, *sums)


def places(df: DataFrame, *keys: str, out: str = "place") -> DataFrame:
    """df with each row's place from 1 in the order of keys."""
    return running(df, list(keys), **{out: F.lit(1).cast("long")})


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None, out: str = "q") -> DataFrame:
    """(by, out): exact quantiles, linear between neighbours, of the rows whose value is not null; one row without `by`, null where there are no values. Distinct values are counted, put in order by ranges and summed up, and the values
    at the places that the quantiles need are picked; no task holds all values of a group."""
    by = by or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    ordered = running(counts, [*by, col], _upto=F.col("_c"))
    # places within a group begin after the rows before it
    of = ordered.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_before"))
    if by:
        of = of.withColumnsRenamed({c: f"_of_{c}" for c in by})
        met = ordered.join(of, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by)))
    else:
        met = ordered.crossJoin(F.broadcast(of))
    place = F.col("_upto") - F.col("_before")
    at = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    picks = [F.min(F.when(place >= side(x) + 1, F.col(col))).alias(f"_{name}{i}") for i, x in enumerate(at) for name, side in (("l", F.floor), ("h", F.ceil))]
    got = met.groupBy(*by).agg(*picks, F.max("_n").alias("_n"))
    value = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (at[i] - F.floor(at[i]))
    return got.select(*by, F.when(F.col("_n").isNotNull(), F.array(*(value(i) for i in range(len(probs))))).alias(out))
