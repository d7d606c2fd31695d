"""Shapes of user functions: batched calls with retry, generators, transformers, backends that may be missing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import vec as V
from lexigraph.sources.rest import with_retry


def batched_call(df: DataFrame, key: str, text: str, call, out: str = "answer string", size: int = 64) -> DataFrame:
    """(key, answer): call gets up to `size` texts at once and gives as many answers; a failing batch is tried again."""
    name = out.split()[0]
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield pd.DataFrame({key: part[key].to_numpy(), name: list(with_retry(call)(part[text].tolist()))})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {out}")


class GroupSimilarity(Estimator):
    """Fits the unit centroid of each group; the model adds a row's similarity to every one, named by group."""

    def __init__(self, vector: str, group: str):
        super().__init__()
        self.vector, self.group = vector, group

    def _fit(self, df: DataFrame) -> GroupSimilarityModel:
        u = df.select(F.col(self.group).alias("g"), V.unit(V.doubles(F.col(self.vector))).alias("u"))
        rows = V.mean_vector(u, ["g"], "u", "c").select("g", V.unit(F.col("c")).alias("c")).orderBy("g").collect()  # a row a group
        return GroupSimilarityModel(self.vector, {r["g"]: list(r["c"]) for r in rows})


class GroupSimilarityModel(Model):
    def __init__(self, vector: str, centroids: dict):
        super().__init__()
        self.vector, self.centroids = vector, centroids

    def feature_names(self) -> list[str]:
        return [f"similarity_{g}" for g in self.centroids]

    def _transform(self, df: DataFrame) -> DataFrame:
        u = V.unit(V.doubles(F.col(self.vector)))
        cols = {n: V.dot(u, F.array(*map(F.lit, c))) for n, c in zip(self.feature_names(), self.centroids.values(), strict=True)}
        return df.withColumns(cols)


def with_backend(df: DataFrame, column: str, backend, fallback) -> DataFrame:
    """column from backend(df), a function from a frame to an expression, or from fallback where no backend is there."""
    return df.withColumn(column, (backend or fallback)(df))


def entropy_of(counts: pd.Series) -> float:
    p = counts.value_counts(normalize=True)
    return float(-sum(x * math.log(x) for x in p))
