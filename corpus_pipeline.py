"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages are cut out, documents with benchmark passages go,
and what is left is encoded. Each stage reads the table that the one before it wrote.

Rows are judged by their texts. A null text counts as an empty one and stays null; empty texts are one group of near-duplicates, whose smallest id stays; very long texts are read whole. Rows without an id are never dropped as near-duplicates; rows of a repeated id are
judged one by one, and equal rows stand or fall together. Of passages that repeat, the place of the smallest id keeps the text. An empty table gives an empty one. All stages but the last keep the columns they get, whatever their names; the last gives samples for text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm.decontaminate import decontaminate_stage
from lexigraph.llm.segsample import encode_stage
from lexigraph.llm.simhash import near_dedup_stage
from lexigraph.llm.suffixes import suffix_stage
from lexigraph.llm.toxicity import toxicity_stage
from lexigraph.shared import cut

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontaminate_stage),
    ("sentencepiece", encode_stage),
]

#: The stages are learned models and sampling, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
