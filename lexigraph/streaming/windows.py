"""Event-time windows, as batch plans and as Structured Streaming over the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.shared import new_path


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def tumbling(df: DataFrame, every: str = "1 hour", *keys: str) -> DataFrame:
    g = df.groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", F.round("total", 4).alias("total"))


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its table; the sink is a table in the shared folder, written once a batch."""
    path, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
