"""File sources and sinks: CSV, JSON, .npy matrices, GEXF, HTML, feeds, and a table cache. All paths go through Spark's file systems."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_indexed_csv(spark: SparkSession, path: str, index: str = "idx") -> DataFrame:
    """A CSV whose first header cell is empty: that column is the index."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed("_c0", index)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of dense matrices in .npy files; each file is one task's, rows are yielded in blocks."""
    import numpy as np
    import pandas as pd

    def run(batches):
        import io

        for pdf in batches:
            for at, raw in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                for k in range(0, len(m), 4096):
                    part = m[k : k + 4096]
                    yield pd.DataFrame({"path": at, "row": np.arange(k, k + len(part)), "vector": list(part.astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, vector array<float>")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first if it is not there (or was left unfinished)."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_collection(df: DataFrame, path: str, id_col: str, vector: str, meta: list[str]) -> None:
    """A vector collection: ids, vectors and a struct of metadata; what stood there before goes."""
    df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.struct(*meta).alias("meta")).write.mode("overwrite").parquet(path)


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GEXF file, in order: (section, key, value). nodes(id, label, ...) and edges(src, dst, weight) are rendered row by row, so the graph's size
    does not matter; order by section and key when writing one file."""
    spark = nodes.sparkSession
    fixed = lambda k, line: spark.createDataFrame([(k, 0, line)], "section int, key long, value string")
    node = F.format_string('<node id="%d" label=%s/>', "id", F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col("label").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"')))
    edge = F.format_string('<edge source="%d" target="%d" weight="%.6f"/>', "src", "dst", "weight")
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected"><nodes>'
    out = fixed(0, head).union(nodes.select(F.lit(1), F.col("id").cast("long"), node)).union(fixed(2, "</nodes><edges>"))
    out = out.union(edges.select(F.lit(3), F.xxhash64("src", "dst"), edge)).union(fixed(4, "</edges></graph></gexf>"))
    return out.toDF("section", "key", "value")


def html_report(df: DataFrame, group: str, order: str, label: str, text: str) -> DataFrame:
    """One HTML page a group: its tokens in order, each in a span of its label's class."""
    span = F.format_string('<span class="%s">%s</span>', F.col(label).cast("string"), F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), span.alias("s")))).alias("a"))
    return rows.select(group, F.concat(F.lit("<html><body><p>"), F.array_join(F.transform("a", lambda x: x["s"]), " "), F.lit("</p></body></html>")).alias("html"))


def rss(title: str, items: list[tuple[str, str, str]]) -> str:
    """A feed of (title, link, date) rows, which the caller has limited."""
    body = "".join(f"<item><title>{escape(a)}</title><link>{escape(b)}</link><pubDate>{escape(c)}</pubDate></item>" for a, b, c in items)
    return f"<rss version={quoteattr('2.0')}><channel><title>{escape(title)}</title>{body}</channel></rss>"
