"""What a physical plan does, read from Spark's own description of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def describe(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(df: DataFrame) -> dict:
    """Counts of exchanges, broadcasts, joins and Python nodes, the filters that reach the scans and the columns they read."""
    text = describe(df)
    tree = text.split("\n\n", 1)[0]
    count = lambda p: len(re.findall(p, tree))
    return {
        "exchanges": count(r"[- ]Exchange \("),
        "broadcasts": count(r"BroadcastExchange"),
        "cartesian": count(r"CartesianProduct|BroadcastNestedLoopJoin"),
        "python": count(r"(MapInArrow|MapInPandas|FlatMapGroups\w+|ArrowEvalPython|BatchEvalPython) "),
        "pushed": re.findall(r"PushedFilters: \[(.*)\]", text),
        "read": re.findall(r"ReadSchema: struct<(.*)>", text),
    }
