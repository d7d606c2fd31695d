"""The last rows of each key, kept by a stream, and drift of them against reference quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexigraph.shared import new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, part int, seen long, ts array<timestamp>, id array<long>, value array<double>"


class Ring(StatefulProcessor):
    """The last `most` rows of a group by (ts, id), as rows may come late; a batch gives the group's state once."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "seen long, ts array<timestamp>, id array<long>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, held = 0, []
        if self.kept.exists():
            seen, *old = self.kept.get()
            held.append(pd.DataFrame(dict(zip(("ts", "id", "value"), old, strict=True))))
        for part in rows:
            seen += len(part)
            held.append(part[["ts", "id", "value"]])
            last = pd.concat(held).sort_values(["ts", "id"], kind="stable").tail(self.most)
            held = [last]
        last = held[0]
        lists = [[v.to_pydatetime() for v in last["ts"]], [int(v) for v in last["id"]], [float(v) for v in last["value"]]]
        self.kept.update((seen, *lists))
        yield pd.DataFrame({"key": [key[0]], "part": [key[1]], "seen": [seen], "ts": [lists[0]], "id": [lists[1]], "value": [lists[2]]})

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, key: str, ts: str, id_col: str, value: str, most: int = 1000, parts: int = 8) -> DataFrame:
    """A stream of states: for each key and part of it, the rows seen and the last `most` by (ts, id). A key is split by a hash of its rows' ids, so one with any share of the rows is kept by several tasks; the last rows of the
    key are among those of its parts (merged). Null keys are a key, rows without ts, id or value are left out."""
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("id"), F.col(value).cast("double").alias("value")).dropna()
    return rows.groupBy("key", "part").transformWithStateInPandas(Ring(most), OUT, "update", "none")

def states(spark: SparkSession, make) -> DataFrame:
    """Runs the stream that make() gives over all that is there, with a state store that processors need, and returns what its batches gave; a batch that runs again writes over its own folder."""
    path, state = new_path(spark, "states"), new_path(spark, "stream-state")
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, ROCKS)
    try:
        stream = make()
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
        stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)
    return spark.read.schema(stream.schema).parquet(path)


def merged(states: DataFrame, most: int = 1000) -> DataFrame:
    """(key, seen, rows: the last `most` as (ts, id, value)) from all states that a stream wrote: the latest of each part, which has seen most."""
    last = states.groupBy("key", "part").agg(F.max(F.struct("seen", "ts", "id", "value")).alias("s"))
    each = last.select("key", "s.seen", F.arrays_zip("s.ts", "s.id", "s.value").alias("r"))
    rows = each.groupBy("key").agg(F.sum("seen").alias("seen"), F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    return rows.select("key", "seen", F.slice("r", F.greatest(F.size("r") - most + 1, F.lit(1)), most).alias("rows"))


def drift(rows: DataFrame, reference: DataFrame, bins: int = 5) -> DataFrame:
    """(key, n, psi): population stability of merged() rows against reference(key, value), in bins of the reference's quantiles; values past its ends go to the end bins, and a bin without rows counts half a row. Keys without a reference have none."""
    q = reference.groupBy("key").agg(F.percentile("value", F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("q"), F.count("value").alias("total"))
    at = lambda v: sum(((v >= F.col("q")[k]).cast("int") for k in range(bins - 1)), F.lit(0))
    count = lambda df: df.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("c"))
    now = rows.select("key", F.explode("rows").alias("r")).select("key", F.col("r.value").alias("value"))
    old_bins = count(reference.join(F.broadcast(q), "key").withColumn("bin", at(F.col("value")))).withColumnRenamed("c", "old")
    new_bins = count(now.join(F.broadcast(q), "key").withColumn("bin", at(F.col("value")))).withColumnRenamed("c", "new")
    grid = q.join(rows.select("key", F.size("rows").alias("n")), "key").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    b = grid.join(old_bins, ["key", "bin"], "left").join(new_bins, ["key", "bin"], "left")
    e, o = F.coalesce("old", F.lit(0.5)) / F.col("total"), F.coalesce("new", F.lit(0.5)) / F.col("n")
    return b.groupBy("key").agg(F.max("n").cast("long").alias("n"), F.sum((o - e) * F.ln(o / e)).alias("psi"))
