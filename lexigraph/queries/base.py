"""The registry: a query, its name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def draw(*parts: Column) -> Column:
    """A number below 2^32 by a hash of the parts as text, which SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(f'({p})::varchar' for p in parts)})), 1, 8))::bigint"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
