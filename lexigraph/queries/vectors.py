"""Sequence operators, geometry and neighbour queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import vec as V
from lexigraph.operators import geometry as G
from lexigraph.operators import metric as M
from lexigraph.operators import sequences as S
from lexigraph.operators.order import places, quantiles

from .base import draw, draw_sql, query, t

E = "e as (select label, vec_id, row_number() over (partition by label order by vec_id) pos, count(*) over (partition by label) n, embedding::DOUBLE[] v from embeddings)"
P = "p as (select a.label, a.vec_id, b.vec_id vec2, a.pos p, b.pos q, list_cosine_similarity(a.v, b.v) sim from e a join e b on a.label = b.label and b.pos > a.pos)"


def seq(spark, d):
    return S.numbered(t(spark, d, "embeddings"), "label", "vec_id", "embedding")


def units(spark, d):
    return G.units(t(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("w01_attention_windows", f"with {E}, {P}, b as (select label, vec_id, min(q) fb from p where sim < 0.05 group by all) select e.label, e.vec_id, coalesce(fb, n + 1) - pos - 1 as win from e left join b using (label, vec_id)")
def w01(spark, d):
    return S.attention_windows(seq(spark, d), [0.05]).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.col("window").alias("win"))


@query("w01_attention_windows_strict", f"with {E}, {P}, b as (select label, vec_id, min(q) fb from p where not sim > 0.1 group by all) select e.label, e.vec_id, coalesce(fb, n + 1) - pos - 1 as win from e left join b using (label, vec_id)")
def w01s(spark, d):
    return S.attention_windows(seq(spark, d), [0.1], inclusive=False).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.col("window").alias("win"))


THETAS = [-1.0, 0.0, 0.05, 0.1]


@query("w02_multi_threshold_windows", f"with {E}, {P}, th(theta) as (values {', '.join(f'({x}::double)' for x in THETAS)}), b as (select theta, label, vec_id, min(q) fb from p, th where sim < theta group by all), w as (select theta, e.label, coalesce(fb, n + 1) - pos - 1 as win from e cross join th left join b using (theta, label, vec_id)) select theta, label, round(avg(win), 6) mean, median(win) med, round(stddev_samp(win), 6) std, count(*) n from w group by all")
def w02(spark, d):
    w = S.attention_windows(seq(spark, d), THETAS)
    x = "window"
    return w.groupBy("theta", F.col("g").alias("label")).agg(F.round(F.avg(x), 6).alias("mean"), F.median(x).alias("med"), F.round(F.stddev_samp(x), 6).alias("std"), F.count(F.lit(1)).alias("n"))


@query("w03_windows_second_vector", "with e as (select label, vec_id, row_number() over (partition by label order by vec_id) pos, count(*) over (partition by label) n, (embedding::DOUBLE[])[33:64] v from embeddings), " + P + ", b as (select label, vec_id, min(q) fb from p where sim < 0.05 group by all) select e.label, e.vec_id, coalesce(fb, n + 1) - pos - 1 as win from e left join b using (label, vec_id)")
def w03(spark, d):
    e = t(spark, d, "embeddings").withColumn("half", F.slice("embedding", 33, 32))
    return S.attention_windows(S.numbered(e, "label", "vec_id", "half"), [0.05]).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.col("window").alias("win"))


DIMS = [8, 16, 32, 64]


@query("w04_dimension_sweep", " union all ".join(f"select {k}::bigint dim, label, round(avg(win), 6) mean, round(stddev_samp(win), 6) std from (with e as (select label, vec_id, row_number() over (partition by label order by vec_id) pos, count(*) over (partition by label) n, (embedding::DOUBLE[])[1:{k}] v from embeddings), {P}, b as (select label, vec_id, min(q) fb from p where sim < 0.05 group by all) select e.label, coalesce(fb, n + 1) - pos - 1 as win from e left join b using (label, vec_id)) group by label" for k in DIMS))
def w04(spark, d):
    e = t(spark, d, "embeddings")
    out = None
    for k in DIMS:
        w = S.attention_windows(S.numbered(e.withColumn("head", F.slice("embedding", 1, k)), "label", "vec_id", "head"), [0.05])
        one = w.groupBy(F.col("g").alias("label")).agg(F.round(F.avg("window"), 6).alias("mean"), F.round(F.stddev_samp("window"), 6).alias("std")).select(F.lit(k).cast("long").alias("dim"), "label", "mean", "std")
        out = one if out is None else out.union(one)
    return out


RUNS = "c as (select conv_id, turn, role, sum(ch) over (partition by conv_id order by turn) run, row_number() over (partition by conv_id order by turn) pos from (select *, case when role is not distinct from lag(role) over (partition by conv_id order by turn) then 0 else 1 end ch from conversations))"


@query("w05_label_run_windows", f"with {RUNS} select conv_id, turn, role, max(pos) over (partition by conv_id, run) - pos as win from c")
def w05(spark, d):
    return S.label_runs(t(spark, d, "conversations"), "conv_id", "turn", "role").withColumnRenamed("window", "win")


@query("w06_change_persistence", "select conv_id, count(*) / (sum(case when prev is not null and role <> prev then 1 else 0 end) + 1) persistence from (select *, lag(role) over (partition by conv_id order by turn) prev from conversations) group by 1")
def w06(spark, d):
    prev = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    c = t(spark, d, "conversations").select("conv_id", F.when(prev.isNotNull() & (F.col("role") != prev), 1).otherwise(0).alias("c"))
    return c.groupBy("conv_id").agg((F.count(F.lit(1)) / (F.sum("c") + 1)).alias("persistence"))


ROLL = f"with {E}, {P}, r as (select label, unnest(generate_series(greatest(1, q - 4), p)) s, sim from p where q - p < 5), c as (select r.label, s, avg(sim) c from r join (select distinct label, n from e) using (label) where s <= n - 4 group by all)"


@query("w07_rolling_coherence", ROLL + " select label, round(avg(c), 6) mean, round(stddev_pop(c), 6) std, round(min(c), 6) lo, round(max(c), 6) hi, count(*) n from c group by 1")
def w07(spark, d):
    c = S.rolling_coherence(seq(spark, d))
    x = "coherence"
    return c.groupBy(F.col("g").alias("label")).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.min(x), 6).alias("lo"), F.round(F.max(x), 6).alias("hi"), F.count(F.lit(1)).alias("n"))


KIND = "e as (select label, vec_id, vec_id % 3 kind, row_number() over (partition by label order by vec_id) pos, count(*) over (partition by label) n, embedding::DOUBLE[] v from embeddings), a as (select label, vec_id, kind, pos, n, list_cosine_similarity(v, lead(v) over (partition by label order by vec_id)) sim, lead(kind) over (partition by label order by vec_id) kind2 from e)"


def transitions(spark, d):
    w = W.partitionBy("g").orderBy("pos")
    e = seq(spark, d).withColumn("kind", F.col("id") % 3).withColumn("kind2", F.lead("kind").over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))
    return S.adjacent(e, ["kind", "kind2", "n"])


@query("w08_transitions", f"with {KIND} select label, vec_id, round(sim, 6) sim, sim < 0.05 broken, case when kind = kind2 then 'same' else 'switch' end type from a where sim is not null")
def w08(spark, d):
    return transitions(spark, d).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"), (F.col("sim") < 0.05).alias("broken"), F.when(F.col("kind") == F.col("kind2"), "same").otherwise("switch").alias("type"))


@query("w09_relative_position", "select conv_id, turn, round(p, 6) p, round(p * p, 6) p2 from (select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1 + 0.5) / (nullif(count(*) over (partition by conv_id) - 1, 0)) p from conversations)")
def w09(spark, d):
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("conv_id"))
    c = t(spark, d, "conversations").select("conv_id", "turn", F.try_divide(k + 0.5, (n - 1).cast("double")).alias("p"))
    return c.select("conv_id", "turn", F.round("p", 6).alias("p"), F.round(F.col("p") * F.col("p"), 6).alias("p2"))


@query("w10_percentile_rank", "select c_custkey, round(100 * (rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2) / count(*) over (), 6) pr from customer")
def w10(spark, d):
    from lexigraph.functions.stats import average_rank

    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    return average_rank(c, "c_nationkey", "r").crossJoin(F.broadcast(n)).select("c_custkey", F.round(100 * F.col("r") / F.col("n"), 6).alias("pr"))


@query("w11_average_rank", "select s_suppkey, rank() over (order by s_nationkey) + (count(*) over (partition by s_nationkey) - 1) / 2 r from supplier")
def w11(spark, d):
    from lexigraph.functions.stats import average_rank

    return average_rank(t(spark, d, "supplier"), "s_nationkey", "r").select("s_suppkey", "r")


@query("w12_quantile_buckets", "with q as (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) q from orders) select o_orderkey, case when o_totalprice <= q[1] then 0 when o_totalprice <= q[2] then 1 when o_totalprice <= q[3] then 2 else 3 end bucket from orders, q")
def w12(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    q = quantiles(o, "o_totalprice", [0.25, 0.5, 0.75])
    x = F.col("o_totalprice")
    return o.crossJoin(F.broadcast(q)).select("o_orderkey", F.when(x <= F.col("q")[0], 0).when(x <= F.col("q")[1], 1).when(x <= F.col("q")[2], 2).otherwise(3).alias("bucket"))


@query("w13_equal_thirds", "select event_id, ntile(3) over (partition by event_type order by ts, event_id) third from events")
def w13(spark, d):
    return t(spark, d, "events").select("event_id", F.ntile(3).over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long").alias("third"))


@query("w14_moving_average", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) / 5, 6) ma from events")
def w14(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return t(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w) / 5, 6).alias("ma"))


@query("w15_previous_next", "select o_custkey, o_orderkey, lag(o_orderkey) over w prev, lead(o_orderkey) over w next from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def w15(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@query("w16_group_ordinal", "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 ordinal from conversations")
def w16(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("ordinal"))


@query("w17_change_markers", "select conv_id, turn, coalesce(role <> lag(role) over (partition by conv_id order by turn), false) changed from conversations")
def w17(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.col("role") != F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(False)).alias("changed"))


@query("a19_split_rate_gap", f"with {KIND}, r as (select avg((sim < 0.05)::int) filter (kind = kind2) same, avg((sim < 0.05)::int) filter (kind <> kind2) switch, count(*) filter (kind = kind2) n_same, count(*) filter (kind <> kind2) n_switch from a where sim is not null) select round(same, 6) same, round(switch, 6) switch, n_same, n_switch, round(switch - same, 6) gap, round(switch / same, 6) ratio from r")
def a19(spark, d):
    x, same = (F.col("sim") < 0.05).cast("double"), F.col("kind") == F.col("kind2")
    r = transitions(spark, d).agg(F.avg(F.when(same, x)).alias("a"), F.avg(F.when(~same, x)).alias("b"), F.count(F.when(same, 1)).alias("n_same"), F.count(F.when(~same, 1)).alias("n_switch"))
    return r.select(F.round("a", 6).alias("same"), F.round("b", 6).alias("switch"), "n_same", "n_switch", F.round(F.col("b") - F.col("a"), 6).alias("gap"), F.round(F.try_divide("b", "a"), 6).alias("ratio"))


U = "u as (select vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) u from embeddings)"
CENT = "c as (select label, list(x order by i) c from (select label, i, avg(x) x from (select label, unnest(u) x, unnest(generate_series(1, len(u))) i from u) group by all) group by 1)"


@query("a20_centroids", f"with {U}, {CENT} select label, round(c[1], 6) c1, round(c[64], 6) c64, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) norm from c")
def a20(spark, d):
    c = V.mean_vector(units(spark, d), ["label"], "u", "c")
    return c.select("label", F.round(F.col("c")[0], 6).alias("c1"), F.round(F.col("c")[63], 6).alias("c64"), F.round(V.norm(F.col("c")), 6).alias("norm"))


@query("a21_cohesion", f"with {E}, {P} select label, round(avg(sim), 6) cohesion from p group by 1")
def a21(spark, d):
    return G.cohesion(units(spark, d), "label").select("label", F.round("cohesion", 6).alias("cohesion"))


@query("a22_dispersion", f"with {U}, {CENT} select label, round(1 - avg(list_cosine_similarity(u, c)), 6) dispersion from u join c using (label) group by 1")
def a22(spark, d):
    return G.dispersion(units(spark, d), "label").select("label", F.round("dispersion", 6).alias("dispersion"))


@query("a23_global_coherence", f"with {E}, {P} select label, round(avg(sim), 6) mean, round(stddev_pop(sim), 6) std from p group by 1 having max(q) >= 3")
def a23(spark, d):
    """From sums by label; no pairs are made."""
    e = t(spark, d, "embeddings").where("label is not null")
    whole = e.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).where("rows >= 3")
    m = whole.join(G.moments(units(spark, d), ["label"], "u"), "label", "left")
    return m.select("label", F.round(F.try_divide("sx", "n"), 6).alias("mean"), F.round(G.spread(F.col("n"), F.col("sx"), F.col("sxx")), 6).alias("std"))


@query("a24_cross_group_similarity", f"with {U}, {CENT} select a.label la, b.label lb, round(list_dot_product(a.c, b.c), 6) sim from c a join c b on a.label < b.label")
def a24(spark, d):
    c = V.mean_vector(units(spark, d), ["label"], "u", "c")
    b = c.select(F.col("label").alias("lb"), F.col("c").alias("cb"))
    return c.join(F.broadcast(b), c["label"] < b["lb"]).select(F.col("label").alias("la"), "lb", F.round(V.dot(F.col("c"), F.col("cb")), 6).alias("sim"))


@query("a25_consecutive_drift", f"with {U}, {CENT} select label, round(list_cosine_similarity(c, lag(c) over (order by label)), 6) cos, coalesce(round(1 - list_cosine_similarity(c, lag(c) over (order by label)), 6), 0) drift from c")
def a25(spark, d):
    c = V.mean_vector(units(spark, d), ["label"], "u", "c")
    cos = V.cosine(F.col("c"), F.lag("c").over(W.orderBy("label")))
    return c.select("label", cos.alias("x")).select("label", F.round("x", 6).alias("cos"), F.coalesce(F.round(1 - F.col("x"), 6), F.lit(0.0)).alias("drift"))


ALL = f"{U}, ap as (select a.vec_id i, b.vec_id j, a.label li, b.label lj, list_dot_product(a.u, b.u) sim from u a join u b on a.vec_id <> b.vec_id)"
KNN = f"{ALL}, knn as (select *, row_number() over (partition by i order by round(sim, 9) desc, j) rnk from ap)"


#: The undirected graph of five neighbours, g(src, dst, weight).
EDGES = f"with {KNN}, g as (select least(i, j) src, greatest(i, j) dst, max(sim) weight from knn where rnk <= 5 group by 1, 2)"


@query("a26_knn_purity", f"with {KNN} select li as label, round(avg((li = lj)::int) filter (rnk = 1), 6) k1, round(avg((li = lj)::int) filter (rnk <= 3), 6) k3 from knn group by 1")
def a26(spark, d):
    k = G.knn(units(spark, d), 3)
    same = (F.col("label_i") == F.col("label_j")).cast("double")
    return k.groupBy(F.col("label_i").alias("label")).agg(F.round(F.avg(F.when(F.col("rank") == 1, same)), 6).alias("k1"), F.round(F.avg(same), 6).alias("k3"))


@query("a30_semantic_entropy", f"with {KIND}, s as (select label, (sim + 1) / 2 s from a where sim is not null), p as (select label, s, s / sum(s) over (partition by label) p from s) select label, round(-sum(p * ln(p + 1e-10)), 6) entropy, round(avg(s), 6) mean from p group by 1")
def a30(spark, d):
    s = S.adjacent(seq(spark, d)).select(F.col("g").alias("label"), ((F.col("sim") + 1) / 2).alias("s"))
    p = s.withColumn("p", F.col("s") / F.sum("s").over(W.partitionBy("label")))
    return p.groupBy("label").agg(F.round(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10)), 6).alias("entropy"), F.round(F.avg("s"), 6).alias("mean"))


@query("a32_adjacent_cosine", f"with {KIND} select label, round(avg(sim), 6) mean from a where sim is not null group by 1")
def a32(spark, d):
    return S.adjacent(seq(spark, d)).groupBy(F.col("g").alias("label")).agg(F.round(F.avg("sim"), 6).alias("mean"))


@query("f28_unit_vectors", f"with {U} select vec_id, round(u[1], 6) a, round(u[2], 6) b from u")
def f28(spark, d):
    return units(spark, d).select(F.col("id").alias("vec_id"), F.round(F.col("u")[0], 6).alias("a"), F.round(F.col("u")[1], 6).alias("b"))


@query("f29_cosine_to_first", "select vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (select embedding::DOUBLE[] from embeddings where vec_id = 0)), 6) sim from embeddings")
def f29(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("o")))).select("vec_id", F.round(V.cosine(F.col("v"), F.col("o")), 6).alias("sim"))


@query("f30_vector_prefix", "select vec_id, len(embedding[1:16]) n, round(list_sum((embedding::DOUBLE[])[1:16]), 6) s from embeddings")
def f30(spark, d):
    h = F.slice(V.doubles(F.col("embedding")), 1, 16)
    return t(spark, d, "embeddings").select("vec_id", F.size(h).cast("long").alias("n"), F.round(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


AXIS = f"{U}, {CENT}, ax as (select list_transform(list_zip(a.c, b.c), lambda z: z[1] - z[2]) x from c a, c b where a.label = 0 and b.label = 1), axu as (select list_transform(x, lambda z: z / sqrt(list_sum(list_transform(x, lambda y: y * y)))) x from ax)"


def axis(e, a=0, b=1):
    """Unit difference of two groups' centroids, as one row."""
    c = V.mean_vector(e.where(F.col("label").isin(a, b)), ["label"], "u", "c")
    poles = c.agg(F.max(F.when(F.col("label") == a, F.col("c"))).alias("a"), F.max(F.when(F.col("label") == b, F.col("c"))).alias("b"))
    return poles.select(V.unit(V.minus(F.col("a"), F.col("b"))).alias("axis"))


@query("f31_axis", f"with {AXIS} select i, round(v, 6) v from (select unnest(x) v, unnest(generate_series(1, len(x))) i from axu)")
def f31(spark, d):
    return axis(units(spark, d)).select(F.posexplode("axis").alias("p", "v")).select((F.col("p") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("f32_axis_projection", f"with {AXIS} select vec_id, round(list_dot_product(u, x), 6) p from u, axu")
def f32(spark, d):
    e = units(spark, d)
    return e.crossJoin(F.broadcast(axis(e))).select(F.col("id").alias("vec_id"), F.round(V.dot(F.col("u"), F.col("axis")), 6).alias("p"))


@query("f33_scrub", "select vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: case when x < 0 then 0 else x end)), 6) s from embeddings")
def f33(spark, d):
    """Negative entries are first turned into NaN, which the scrubber sets to zero."""
    bad = F.transform(V.doubles(F.col("embedding")), lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(x))
    return t(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(V.scrub(bad), F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("f34_theta_all_pairs", f"with {ALL} select round(median(sim), 6) med, round(stddev_pop(sim), 6) std from ap")
def f34(spark, d):
    """The median counts all pairs; the deviation comes from sums over rows, less those of repeated ids."""
    e = units(spark, d).where("id is not null")
    s = G.pair_moments(e, "u")
    return s.select(F.round(F.lit(M.middle(e.select("id", "u"))).cast("double"), 6).alias("med"), F.round(G.spread(F.col("n"), F.col("sx"), F.col("sxx")), 6).alias("std"))


@query("f34_theta_sampled", f"""with {U}, r as (select row_number() over (order by vec_id) k, u from u), n as (select count(*) n from r),
    p as (select {draw_sql('d.i', '1')} % n + 1 a, {draw_sql('d.i', '2')} % n + 1 b from range(5000) d(i), n), s as (select list_dot_product(x.u, y.u) sim from p join r x on x.k = a join r y on y.k = b where a <> b)
    select round(median(sim), 6) med, round(stddev_pop(sim), 6) std from s""")
def f34b(spark, d):
    """5000 pairs by hash of their number; the same on every run."""
    e = places(units(spark, d).select("id", "u"), "id", out="k")
    n = e.count()
    pick = lambda seed: draw(F.col("id"), F.lit(seed)) % max(1, n) + 1
    k = spark.range(5000).select(pick(1).alias("i"), pick(2).alias("j")).where("i <> j")
    p = k.join(e.select(F.col("k").alias("i"), F.col("u").alias("a")), "i").join(e.select(F.col("k").alias("j"), F.col("u").alias("b")), "j")
    return p.select(V.dot(F.col("a"), F.col("b")).alias("sim")).agg(F.round(F.median("sim"), 6).alias("med"), F.round(F.stddev_pop("sim"), 6).alias("std"))


@query("f36_shifted_similarity", f"with {KIND} select vec_id, round((sim + 1) / 2, 6) s from a where sim is not null")
def f36(spark, d):
    return S.adjacent(seq(spark, d)).select(F.col("id").alias("vec_id"), F.round((F.col("sim") + 1) / 2, 6).alias("s"))


@query("j08_all_pairs", f"with {ALL} select count(*) n, round(avg(sim), 6) mean from ap where i < j")
def j08(spark, d):
    return G.pair_sums(units(spark, d)).select("n", F.round(F.try_divide("total", "n"), 6).alias("mean"))


@query("j09_threshold_join", f"with {ALL} select i, j, round(sim, 6) sim from ap where i < j and li <> lj and sim > 0.4")
def j09(spark, d):
    return M.all_pairs(units(spark, d), 0.4, apart="label").select("i", "j", F.round("sim", 6).alias("sim"))


@query("j10_masked_top_pairs", f"with {ALL} select i, j, round(sim, 6) sim from ap where i < j and li <> lj order by round(sim, 9) desc, i, j limit 20")
def j10(spark, d):
    return M.top_pairs(units(spark, d), 20, apart="label").select("i", "j", F.round("sim", 6).alias("sim"))


@query("j11_best_cross_pair", f"with {ALL}, b as (select li, lj, i, j, sim, row_number() over (partition by li, lj order by round(sim, 9) desc, i, j) rn from ap where li < lj) select li, lj, i, j, round(sim, 6) sim from b where rn = 1")
def j11(spark, d):
    return M.best_between(units(spark, d), "label").select(F.col("g").alias("li"), F.col("h").alias("lj"), "i", "j", F.round("sim", 6).alias("sim"))


@query("j12_knn", f"with {KNN} select i, j, rnk from knn where rnk <= 5")
def j12(spark, d):
    return G.knn(units(spark, d), 5).select("i", "j", F.col("rank").alias("rnk"))


@query("j13_k_farthest", f"with {ALL}, f as (select *, row_number() over (partition by i order by round(sim, 9), j) rnk from ap) select i, j, rnk from f where rnk <= 5")
def j13(spark, d):
    return G.knn(units(spark, d), 5, far=True).select("i", "j", F.col("rank").alias("rnk"))


@query("j14_cross_corpus", f"with {U} select a.vec_id i, b.vec_id j, round(list_dot_product(a.u, b.u), 6) sim from u a, u b where a.label = 0 and b.label = 1")
def j14(spark, d):
    e = units(spark, d)
    return G.cross(e.where("label = 0"), e.where("label = 1"))


@query("j15_adjacent_pairs", f"with {KIND} select vec_id, round(sim, 6) sim from a where sim is not null")
def j15(spark, d):
    return S.adjacent(seq(spark, d)).select(F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


@query("j16_point_knn", f"with {U} select vec_id, round(1 - list_dot_product(u, (select u from u where vec_id = 7)), 6) dist from u where vec_id <> 7 order by dist, vec_id limit 10")
def j16(spark, d):
    e = units(spark, d)
    q = e.where("id = 7").select(F.col("u").alias("q"))
    return e.where("id <> 7").crossJoin(F.broadcast(q)).select(F.col("id").alias("vec_id"), F.round(1 - V.dot(F.col("u"), F.col("q")), 6).alias("dist")).orderBy("dist", "vec_id").limit(10)


@query("j19_knn_classifier", f"with {KNN}, v as (select i, lj, count(*) c from knn where rnk <= 5 group by all), b as (select i, lj, row_number() over (partition by i order by c desc, lj) rn from v) select i, lj as predicted from b where rn = 1")
def j19(spark, d):
    v = G.knn(units(spark, d), 5).groupBy("i", "label_j").agg(F.count(F.lit(1)).alias("c"))
    return v.groupBy("i").agg(F.min(F.struct((-F.col("c")).alias("m"), "label_j")).alias("b")).select("i", F.col("b.label_j").alias("predicted"))


@query("t05_exemplars", f"with {U}, {CENT}, s as (select label, vec_id, row_number() over (partition by label order by round(list_cosine_similarity(u, c), 9) desc, vec_id) rn from u join c using (label)) select label, vec_id from s where rn <= 6")
def t05(spark, d):
    e = units(spark, d)
    c = V.mean_vector(e, ["label"], "u", "c")
    s = e.join(c, "label").select("label", F.col("id").alias("vec_id"), F.round(V.cosine(F.col("u"), F.col("c")), 9).alias("sim"))
    return s.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("sim"), "vec_id"))).where("rn <= 6").select("label", "vec_id")


@query("m16_field_coverage", f"with {U}, {CENT}, f as (select vec_id field, u from u where vec_id < 8) select field, round(max(list_cosine_similarity(c, u)), 6) best from c, f group by 1")
def m16(spark, d):
    e = units(spark, d)
    c = V.mean_vector(e, ["label"], "u", "c")
    f = e.where("id < 8").select(F.col("id").alias("field"), "u")
    return c.crossJoin(F.broadcast(f)).groupBy("field").agg(F.round(F.max(V.cosine(F.col("c"), F.col("u"))), 6).alias("best"))
