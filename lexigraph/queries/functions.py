"""User functions of every shape the analyses use, next to their native forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexigraph.operators import udfs as X

from .base import query, t
from .vectors import CENT, U


@query("x01_scalar_function", "select doc_id, length(trim(lower(text))) n from documents")
def x01(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(F.trim(F.lower("text"))).cast("long").alias("n"))


@query("x02_row_function", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) total from lineitem")
def x02(spark, d):
    r = F.struct("l_extendedprice", "l_discount", "l_tax")
    total = r["l_extendedprice"] * (1 - r["l_discount"]) * (1 + r["l_tax"])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"))


@query("x03_two_outputs", "select p_partkey, string_split(p_name, ' ')[1] colour, string_split(p_name, ' ')[2] kind from part")
def x03(spark, d):
    parts = F.split("p_name", " ")
    return t(spark, d, "part").select("p_partkey", F.struct(parts[0].alias("colour"), parts[1].alias("kind")).alias("s")).select("p_partkey", "s.*")


@query("x04_group_to_rows", "select conv_id, turn, length(text) - first_value(length(text)) over (partition by conv_id order by turn) more from conversations")
def x04(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        return pdf[["conv_id", "turn"]].assign(more=pdf["n"] - pdf["n"].iloc[0])

    rows = t(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return rows.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, more long")


@query("x05_group_to_scalar", "with n as (select source, lang, count(*) n from documents group by all), p as (select source, n::double / sum(n) over (partition by source) p from n) select source, round(-sum(p * ln(p)), 6) h from p group by 1")
def x05(spark, d):
    @F.pandas_udf("double")
    def h(x: pd.Series) -> float:
        return X.entropy_of(x)

    return t(spark, d, "documents").groupBy("source").agg(F.round(h("lang"), 6).alias("h"))


@query("x06_one_to_many", "select s_suppkey, i, s_suppkey * i v from supplier, lateral unnest([1::bigint, 2, 3]) u(i)")
def x06(spark, d):
    @F.udtf(returnType="i bigint, v bigint")
    class Multiples:
        def eval(self, k: int):
            for i in (1, 2, 3):
                yield i, k * i

    spark.udtf.register("lexigraph_multiples", Multiples)
    t(spark, d, "supplier").createOrReplaceTempView("lexigraph_supplier")
    return spark.sql("select s_suppkey, m.i, m.v from lexigraph_supplier, lateral lexigraph_multiples(s_suppkey) m")


@query("x07_batched_call", "select item_id, left(text, 20) answer from benchmark")
def x07(spark, d):
    return X.batched_call(t(spark, d, "benchmark"), "item_id", "text", lambda texts: [x[:20] for x in texts])


@query("x08_fitted_transformer", f"with {U}, {CENT}, a as (select list(c order by label) cs from c) select vec_id, " + ", ".join(f"round(list_cosine_similarity(u, cs[{k + 1}]), 6) similarity_{k}" for k in range(10)) + " from u, a")
def x08(spark, d):
    e = t(spark, d, "embeddings")
    m = X.GroupSimilarity("embedding", "label").fit(e)
    return m.transform(e).select("vec_id", *(F.round(n, 6).alias(n) for n in m.feature_names()))


@query("x09_backend_or_fallback", "select doc_id, coalesce(lang, 'OTHER') label from documents")
def x09(spark, d):
    return X.with_backend(t(spark, d, "documents"), "label", None, lambda df: F.coalesce(F.col("lang"), F.lit("OTHER"))).select("doc_id", "label")
