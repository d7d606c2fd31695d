"""Sources and sinks, each as a round trip through files in the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import audio as AU
from lexigraph.operators import geometry as geo
from lexigraph.shared import new_path
from lexigraph.sources import copying as CP
from lexigraph.sources import files as S
from lexigraph.sources.rest import RestSource

from .base import query, t
from .vectors import KNN, units

NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("s01_parquet_scan", "select doc_id, lang, n_chars from documents where n_chars > 2000")
def s01(spark, d):
    return t(spark, d, "documents").where("n_chars > 2000").select("doc_id", "lang", "n_chars")


@query("s02_parquet_sink", "select c_custkey, c_mktsegment from customer")
def s02(spark, d):
    path = new_path(spark, "s02")
    t(spark, d, "customer").select("c_custkey", "c_mktsegment").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("s03_csv_scan", "select n_nationkey, n_name, n_regionkey from nation")
def s03(spark, d):
    path = new_path(spark, "s03")
    S.write_csv(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return S.read_csv(spark, path, NATION)


@query("s05_csv_with_index", "select s_suppkey idx, s_name from supplier")
def s05(spark, d):
    path = new_path(spark, "s05")
    t(spark, d, "supplier").select(F.col("s_suppkey").alias(" "), "s_name").write.option("header", True).csv(path)
    return S.read_indexed_csv(spark, path).toDF("idx", "s_name").select(F.col("idx").cast("long").alias("idx"), "s_name")


@query("s06_csv_sink", "select r_regionkey, r_name from region")
def s06(spark, d):
    path = new_path(spark, "s06")
    S.write_csv(t(spark, d, "region").select("r_regionkey", "r_name"), path)
    return S.read_csv(spark, path, "r_regionkey int, r_name string")


@query("s07_nested_json", "select s_suppkey, s_name, s_acctbal from supplier")
def s07(spark, d):
    path = new_path(spark, "s07")
    S.write_json_lines(t(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_acctbal").alias("balance")).alias("account")).alias("doc")), path)
    back = S.read_json(spark, path, "s_suppkey long, doc struct<name:string, account:struct<balance:double>>")
    return back.select("s_suppkey", F.col("doc.name").alias("s_name"), F.col("doc.account.balance").alias("s_acctbal"))


@query("s08_json_array", "select n_nationkey, n_name from nation")
def s08(spark, d):
    path = new_path(spark, "s08")
    one = t(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    one.select("value").repartition("value").write.text(path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<n_nationkey:int, n_name:string>>")).alias("s")).select("s.*")


@query("s09_json_sink", "select lang, count(*) n from documents group by 1")
def s09(spark, d):
    path = new_path(spark, "s09")
    S.write_json_lines(t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    return S.read_json(spark, path, "lang string, n long")


@query("s10_npy_matrix")
def s10(spark, d):
    """Vectors written as one .npy matrix a label and read back by the importer."""
    import io
    import uuid

    import numpy as np
    import pandas as pd

    path = new_path(spark, "s10")

    def save(pdf):
        from lexigraph.sources.store import open_output

        raw = io.BytesIO()
        np.save(raw, np.stack(pdf.sort_values("vec_id")["embedding"].to_list()).astype("float32"))
        with open_output(f"{path}/{int(pdf['label'].iloc[0])}-{uuid.uuid4().hex}.npy") as f:
            f.write(raw.getvalue())
        return pd.DataFrame({"label": [int(pdf["label"].iloc[0])], "n": [len(pdf)]})

    t(spark, d, "embeddings").groupBy("label").applyInPandas(save, "label int, n long").agg(F.sum("n")).collect()
    return S.read_npy(spark, path + "/*.npy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


@query("s12_table_cache", "select source, sum(n_chars)::bigint chars from documents group by 1")
def s12(spark, d):
    path = new_path(spark, "s12")
    make = lambda: t(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    S.cached_table(spark, path, make)
    return S.cached_table(spark, path, make)


@query("s13_paginated_source", "select q as query, q || '-' || i as id, 'item ' || i || ' of ' || q as text from (values ('a'), ('b'), ('c')) v(q), range(0, 120) r(i)")
def s13(spark, d):
    spark.dataSource.register(RestSource)
    return spark.read.format("rest_pages").option("queries", json.dumps(["a", "b", "c"])).load()


@query("s14_capped_source", "select q as query, count(*) n from (values ('a'), ('b')) v(q), range(0, 75) r(i) group by 1")
def s14(spark, d):
    """Row cap of a source; pages that fail at first are fetched again."""
    spark.dataSource.register(RestSource)
    return spark.read.format("rest_pages").option("queries", json.dumps(["a", "b"])).option("most", 75).option("page", 25).load().groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("s15_variant_lookup", "select p_partkey, coalesce(a.n_name, b.n_name) hit from part left join nation a on a.n_nationkey = p_size left join nation b on b.n_nationkey = p_size - 25")
def s15(spark, d):
    n = t(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    p = t(spark, d, "part").select("p_partkey", "p_size")
    return p.join(a, F.col("p_size") == F.col("ka"), "left").join(b, F.col("p_size") - 25 == F.col("kb"), "left").select("p_partkey", F.coalesce("a", "b").alias("hit"))


@query("s16_html_scrape", "select page_id, left(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), 100) head, len(regexp_extract_all(html, '<p[^>]*>')) paragraphs from pages")
def s16(spark, d):
    html = F.col("html")
    return t(spark, d, "pages").select("page_id", F.substring(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1), 1, 100).alias("head"), F.size(F.regexp_extract_all(html, F.lit("<p[^>]*>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("s16_html_text")
def s16b(spark, d):
    """The article's text, or the paragraphs of over 50 characters where there is none; at most 8000 characters."""
    article = F.regexp_extract("html", "(?s)<article[^>]*>(.*?)</article>", 1)
    paragraphs = F.filter(F.transform(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), T.strip_tags), lambda p: F.length(p) > 50)
    return t(spark, d, "pages").select("page_id", F.substring(F.when(article != "", T.strip_tags(article)).otherwise(F.array_join(paragraphs, "\n")), 1, 8000).alias("text"))


@query("s17_audio_features")
def s17(spark, d):
    """Features of sound over the bytes of each text as 8-bit samples."""
    x = t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("samples"))
    out = AU.scan(x, "doc_id", "samples", bits=8)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in AU.NAMES))


@query("s22_store_copy", "select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total, true as whole from orders group by 1")
def s22(spark, d):
    """A table copied with a manifest, copied again with nothing to do, and read from its copy."""
    source, target = new_path(spark, "s22-from"), new_path(spark, "s22-to")
    t(spark, d, "orders").select("o_orderstatus", "o_totalprice").repartition(4).write.parquet(source)
    first, again = CP.copy_table(spark, source, target), CP.copy_table(spark, source, target)
    whole = first.agg(F.coalesce(F.every("copied"), F.lit(True)).alias("a")).crossJoin(again.agg((~F.coalesce(F.some("copied"), F.lit(False))).alias("b"))).select((F.col("a") & F.col("b")).alias("whole"))
    back = spark.read.schema("o_orderstatus string, o_totalprice double").parquet(target)
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).crossJoin(F.broadcast(whole))


@query("s18_vector_collection", "select vec_id::varchar id, label, len(embedding) dim from embeddings")
def s18(spark, d):
    path = new_path(spark, "s18")
    S.replace_collection(t(spark, d, "embeddings"), path, "vec_id", "embedding", ["label"])
    return spark.read.parquet(path).select("id", F.col("meta.label").alias("label"), F.size("vector").cast("long").alias("dim"))


@query("s19_unique_check", "select o_custkey, count(*) n from orders group by 1 having count(*) > 1")
def s19(spark, d):
    """Keys that break a UNIQUE(o_custkey) rule; none are returned for a table that keeps it."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("s20_gexf", f"with {KNN} select (select count(*) from embeddings) n_nodes, count(*) n_edges from (select distinct least(i, j), greatest(i, j) from knn where rnk <= 3)")
def s20(spark, d):
    e = units(spark, d)
    path = new_path(spark, "s20")
    S.gexf(e.select("id", "label"), geo.knn_graph(e, 3)).repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("value").write.text(path)
    x = spark.read.text(path)
    return x.agg(F.sum(F.col("value").startswith("<node id").cast("long")).alias("n_nodes"), F.sum(F.col("value").startswith("<edge ").cast("long")).alias("n_edges"))


@query("s21_html_report", "select conv_id, '<html><body><p>' || string_agg('<span class=\"' || role || '\">' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</span>', ' ' order by turn) || '</p></body></html>' html from conversations group by 1")
def s21(spark, d):
    return S.html_report(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("s23_site_index", "select page_id, url, length(html) n from pages where not contains(url, 'search')")
def s23(spark, d):
    path = new_path(spark, "s23")
    p = t(spark, d, "pages").where(~F.contains("url", F.lit("search"))).select("page_id", "url", F.length("html").alias("n"))
    S.write_json_lines(p, path)
    return S.read_json(spark, path, "page_id long, url string, n long")


@query("s24_feed", """select '<rss version="2.0"><channel><title>orders</title>' || string_agg('<item><title>' || o_orderkey || '</title><link>/orders/' || o_orderkey || '</link><pubDate>' || strftime(o_orderdate, '%Y-%m-%d') || '</pubDate></item>', '' order by o_orderdate desc, o_orderkey) || '</channel></rss>' xml
    from (select * from orders order by o_orderdate desc, o_orderkey limit 20)""")
def s24(spark, d):
    rows = t(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select(F.col("o_orderkey").cast("string"), F.concat(F.lit("/orders/"), "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")).collect()
    return spark.createDataFrame([(S.rss("orders", [tuple(r) for r in rows]),)], "xml string")


@query("s25_model_save", "select c_custkey, (1 + (select count(distinct c_mktsegment) from customer))::int dim from customer")
def s25(spark, d):
    from pyspark.ml import PipelineModel

    from lexigraph.operators.learning import preprocessor

    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    path = new_path(spark, "s25")
    preprocessor(["c_acctbal"], ["c_mktsegment"]).fit(c).write().overwrite().save(path)
    from pyspark.ml.functions import vector_to_array

    return PipelineModel.load(path).transform(c).select("c_custkey", F.size(vector_to_array("features")).alias("dim"))


@query("s26_inline_relation", "select * from (values ('first', 1::bigint, 'a'), ('first', 2, 'b'), ('second', 1, 'c')) v(album, track_num, title)")
def s26(spark, d):
    rel = spark.createDataFrame([("first", ["a", "b"]), ("second", ["c"])], "album string, tracks array<string>")
    return rel.select("album", F.posexplode("tracks").alias("p", "title")).select("album", (F.col("p") + 1).cast("long").alias("track_num"), "title")
