"""Similarity graphs over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.operators import geometry as geo
from lexigraph.operators import graph as G
from lexigraph.operators.components import connected_components

from .base import query, t
from .vectors import EDGES, KNN, units


def graph(spark, d):
    e = units(spark, d)
    return e.select("id"), geo.knn_graph(e, 5)


BOTH = "b as (select src, dst, weight from g union all select dst, src, weight from g)"


@query("g01_knn_graph", f"{EDGES} select src, dst, round(weight, 6) weight from g")
def g01(spark, d):
    return graph(spark, d)[1].select("src", "dst", F.round("weight", 6).alias("weight"))


@query("g01_knn_graph_mutual", f"with {KNN} select least(i, j) src, greatest(i, j) dst from knn where rnk <= 5 group by 1, 2 having count(*) = 2")
def g01m(spark, d):
    return geo.knn_graph(units(spark, d), 5, mutual=True).select("src", "dst")


@query("g02_threshold_graph", f"with {KNN} select i as src, j as dst, round(sim, 6) weight from knn where i < j and sim > 0.35")
def g02(spark, d):
    return geo.all_pairs(units(spark, d), least=0.35).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.round("sim", 6).alias("weight"))


@query("g03_density", f"{EDGES} select n n_nodes, m n_edges, round(2.0 * m / (n * (n - 1)), 6) density from (select count(*) n from embeddings), (select count(*) m from g)")
def g03(spark, d):
    return G.summary(*graph(spark, d)).withColumn("density", F.round("density", 6))


@query("g04_components", f"with recursive {KNN}, g as materialized (select i, j from knn where i < j and sim > 0.35 union select j, i from knn where i < j and sim > 0.35), r as (select vec_id as id, vec_id as c from embeddings union select g.j, r.c from r join g on r.id = g.i) select id, min(c) component from r group by 1")
def g04(spark, d):
    e = units(spark, d)
    edges = geo.all_pairs(e, least=0.35)
    return e.select("id").join(connected_components(edges, "i", "j").withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("g05_average_path")
def g05(spark, d):
    nodes, edges = graph(spark, d)
    p = G.path_lengths(nodes, edges)
    return p.agg(F.round(F.try_divide(F.sum("total"), F.sum("reached")), 6).alias("average_path"), F.max("reached").alias("largest"))


@query("g06_clustering", f"{EDGES}, {BOTH}, d as (select src id, count(*) d from b group by 1), tr as (select x.src id, count(*) n from b x join b y on x.src = y.src and x.dst < y.dst join g on g.src = x.dst and g.dst = y.dst group by 1) select round(avg(case when coalesce(d, 0) < 2 then 0 else 2.0 * coalesce(n, 0) / (d * (d - 1)) end), 6) cc from (select vec_id id from embeddings) left join d using (id) left join tr using (id)")
def g06(spark, d):
    return G.clustering(*graph(spark, d)).agg(F.round(F.avg("cc"), 6).alias("cc"))


@query("g07_weighted_degree", f"{EDGES}, {BOTH} select src id, round(sum(weight), 6) w_degree from b group by 1")
def g07(spark, d):
    return G.degrees(*graph(spark, d)).where("degree > 0").select("id", F.round("w_degree", 6).alias("w_degree"))


@query("g08_degree_centrality", f"{EDGES}, {BOTH} select src id, round(count(*) / (select count(*) - 1 from embeddings), 6) centrality from b group by 1 order by count(*) desc, src limit 10")
def g08(spark, d):
    nodes, edges = graph(spark, d)
    n = nodes.agg((F.count(F.lit(1)) - 1).alias("n"))
    return G.degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(10).crossJoin(F.broadcast(n)).select("id", F.round(F.try_divide(F.col("degree"), F.col("n")), 6).alias("centrality"))


@query("g09_betweenness")
def g09(spark, d):
    return G.betweenness(*graph(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("g10_louvain")
def g10(spark, d):
    return G.louvain(*graph(spark, d))


LABELS = "x as (select g.*, a.label la, c.label lb from g join embeddings a on a.vec_id = src join embeddings c on c.vec_id = dst)"


@query("g11_modularity", f"{EDGES}, {LABELS}, m as (select sum(weight) m from g), k as (select l, sum(weight) k from (select la l, weight from x union all select lb, weight from x) group by 1), i as (select la l, sum(weight) w from x where la = lb group by 1) select round(sum(coalesce(w, 0) / m - (k / (2 * m)) ** 2), 6) modularity from k left join i using (l), m")
def g11(spark, d):
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return G.modularity(graph(spark, d)[1], labels).select(F.round("modularity", 6).alias("modularity"))


@query("g12_cross_fraction", f"{EDGES}, {LABELS} select round(avg((la <> lb)::int), 6) cross_fraction from x")
def g12(spark, d):
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return G.cross_fraction(graph(spark, d)[1], labels).select(F.round("cross_fraction", 6).alias("cross_fraction"))


@query("g12_cross_ratio_nodes", f"{EDGES}, {LABELS} select id, round(avg(c), 6) ratio from (select src id, (la <> lb)::int c from x union all select dst, (la <> lb)::int from x) group by 1")
def g12b(spark, d):
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    e = G.both(graph(spark, d)[1])
    x = e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return x.groupBy(F.col("src").alias("id")).agg(F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 6).alias("ratio"))


@query("g13_community_composition")
def g13(spark, d):
    nodes, edges = graph(spark, d)
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    return G.louvain(nodes, edges).join(labels, "id").groupBy(F.col("label").alias("community"), "group").agg(F.count(F.lit(1)).alias("n"))


@query("g15_subgraph", f"{EDGES}, {BOTH}, k as (select src id from b group by 1 having count(*) >= 8) select src, dst from g where src in (select id from k) and dst in (select id from k)")
def g15(spark, d):
    return G.subgraph(*graph(spark, d), 8)[1].select("src", "dst")


@query("t03_top_edges", f"{EDGES} select src, dst, round(weight, 6) weight from g order by round(weight, 9) desc, src, dst limit 15")
def t03(spark, d):
    return graph(spark, d)[1].orderBy(F.desc(F.round("weight", 9)), "src", "dst").limit(15).select("src", "dst", F.round("weight", 6).alias("weight"))
