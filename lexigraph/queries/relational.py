"""Projections, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import fuzzy as Z
from lexigraph.operators.order import places, quantiles, running

from .base import draw, draw_sql, query, t

# ---- projections, filters, predicates


@query("p01_projection", "select c_custkey, c_name, c_mktsegment from customer")
def p01(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("p02_derived_columns", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) revenue, round(ln(1 + l_quantity), 6) log_quantity from lineitem")
def p02(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"), F.round(F.log1p("l_quantity"), 6).alias("log_quantity"))


@query("p03_rename", "select s_suppkey as supplier_id, s_name as supplier_name from supplier")
def p03(spark, d):
    return t(spark, d, "supplier").withColumnRenamed("s_suppkey", "supplier_id").withColumnRenamed("s_name", "supplier_name").select("supplier_id", "supplier_name")


@query("p04_equality_filter", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def p04(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("p05_conjunctive_filter", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity > 30 and l_discount <= 0.05")
def p05(spark, d):
    return t(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30) & (F.col("l_discount") <= 0.05)).select("l_orderkey", "l_linenumber")


@query("p06_in_list", "select event_id, event_type from events where event_type in ('click', 'purchase')")
def p06(spark, d):
    return t(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("p07_not_equal_keeps_null", "select doc_id, lang from documents where lang is distinct from 'en'")
def p07(spark, d):
    return t(spark, d, "documents").where(~F.col("lang").eqNullSafe("en")).select("doc_id", "lang")


#: a column with gaps: every fifth value is missing
GAPS = "case when c_custkey % 5 = 0 then null else c_acctbal end"


@query("p08_null_drop", f"select c_custkey, x from (select c_custkey, {GAPS} x from customer) where x is not null")
def p08(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.expr(GAPS).alias("x")).na.drop(subset=["x"])


@query("p09_null_fill_constant", f"select c_custkey, coalesce({GAPS}, 0) x from customer")
def p09(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.expr(GAPS).alias("x")).na.fill(0.0, ["x"])


@query("p10_null_fill_median", f"with a as (select c_custkey, {GAPS} x from customer) select c_custkey, coalesce(x, (select median(x) from a), 1) x from a")
def p10(spark, d):
    a = t(spark, d, "customer").select("c_custkey", F.expr(GAPS).alias("x"))
    return a.crossJoin(F.broadcast(quantiles(a, "x", [0.5]))).select("c_custkey", F.coalesce("x", F.col("q")[0], F.lit(1.0)).alias("x"))


@query("p11_numeric_coercion", "select o_orderkey, try_cast(left(o_orderpriority, 1) as double) prio, try_cast(o_orderpriority as double) bad from orders")
def p11(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("double").alias("prio"), F.col("o_orderpriority").try_cast("double").alias("bad"))


@query("p12_timestamp_coercion", "select event_id, year(try_cast(s as timestamp)) y, try_cast(s as timestamp) is null bad from (select event_id, case when event_id % 7 = 0 then 'n/a' else strftime(ts, '%Y-%m-%d %H:%M:%S') end s from events)")
def p12(spark, d):
    s = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    x = F.try_to_timestamp(F.col("s"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return t(spark, d, "events").select("event_id", s.alias("s")).select("event_id", F.year(x).cast("long").alias("y"), x.isNull().alias("bad"))


@query("p13_nullable_integer", "select event_id, cast(floor(case when event_id % 3 = 0 then null else value end) as bigint) v from events")
def p13(spark, d):
    return t(spark, d, "events").select("event_id", F.floor(F.when(F.col("event_id") % 3 != 0, F.col("value"))).cast("bigint").alias("v"))


@query("p14_recode_with_default", "select doc_id, case lang when 'en' then 'germanic' when 'de' then 'germanic' when 'fr' then 'romance' else 'other' end family from documents")
def p14(spark, d):
    family = F.create_map(*map(F.lit, ("en", "germanic", "de", "germanic", "fr", "romance")))
    return t(spark, d, "documents").select("doc_id", F.coalesce(F.element_at(family, F.col("lang")), F.lit("other")).alias("family"))


@query("p15_case_ladder", "select event_id, case when value > 50 then 'high' when value > 10 then 'middle' when value > 0 then 'low' else 'none' end band from events")
def p15(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", F.when(v > 50, "high").when(v > 10, "middle").when(v > 0, "low").otherwise("none").alias("band"))


@query("p16_validation", """select c_custkey, upper(c_mktsegment) segment, (c_acctbal between -500 and 5000) and upper(c_mktsegment) in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') ok,
    (case when c_acctbal between -500 and 5000 then 0 else 1 end) + (case when upper(c_mktsegment) in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') then 0 else 1 end) n_errors from customer""")
def p16(spark, d):
    segment = F.upper("c_mktsegment")
    a, b = F.col("c_acctbal").between(-500, 5000), segment.isin("BUILDING", "MACHINERY", "AUTOMOBILE")
    errors = F.filter(F.array(F.when(~a, "balance"), F.when(~b, "segment")), lambda x: x.isNotNull())
    return t(spark, d, "customer").select("c_custkey", segment.alias("segment"), (a & b).alias("ok"), F.size(errors).alias("n_errors"))


def first_column(df, *names):
    """The first of the names that df has, else None."""
    return next((n for n in names if n in df.columns), None)


@query("p17_first_available_column", "select page_id, length(html) n_chars from pages")
def p17(spark, d):
    pages = t(spark, d, "pages")
    return pages.select("page_id", F.length(first_column(pages, "text", "body", "html")).cast("long").alias("n_chars"))


@query("p18_empty_in_empty_out", "select lang, count(*) n from documents where lang = 'xx' group by lang")
def p18(spark, d):
    return t(spark, d, "documents").where(F.col("lang") == "xx").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("p19_row_id", "select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) - 1 row_id from supplier")
def p19(spark, d):
    return places(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", (F.col("place") - 1).alias("row_id"))


@query("p20_numeric_columns", "select p_partkey, p_size, p_retailprice from part")
def p20(spark, d):
    part = t(spark, d, "part")
    return part.select([c for c, kind in part.dtypes if kind in ("bigint", "int", "double", "float", "smallint")])


@query("p21_site_filter", "select page_id, url from pages where contains(url, '/en/') and not contains(url, '#')")
def p21(spark, d):
    return t(spark, d, "pages").where(F.contains("url", F.lit("/en/")) & ~F.contains("url", F.lit("#"))).select("page_id", "url")


# ---- joins


@query("j01_inner_join", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
def j01(spark, d):
    orders = t(spark, d, "orders").where("o_totalprice > 300000")
    return orders.join(t(spark, d, "customer"), orders["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("j02_left_join", "select d.doc_id, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def j02(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("j03_left_join_composite", "select a.conv_id, a.turn, b.role previous_role from conversations a left join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1")
def j03(spark, d):
    a = t(spark, d, "conversations").select("conv_id", "turn")
    b = t(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous_role"))
    return a.join(b, ["conv_id", "turn"], "left")


@query("j04_join_with_suffixes", "select a.c_nationkey, a.n n_customer, b.n n_supplier from (select c_nationkey, count(*) n from customer group by 1) a join (select s_nationkey, count(*) n from supplier group by 1) b on a.c_nationkey = b.s_nationkey")
def j04(spark, d):
    a = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customer"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n_supplier"))
    return a.join(b, "c_nationkey")


@query("j05_join_on_normal_key", "select c_custkey, n_name from (select c_custkey, lower(trim(cast(c_nationkey as varchar))) k from customer) join (select n_name, lower(trim(cast(n_nationkey as varchar))) k from nation) using (k)")
def j05(spark, d):
    a = t(spark, d, "customer").select("c_custkey", F.lower(F.trim(F.col("c_nationkey").cast("string"))).alias("k"))
    b = t(spark, d, "nation").select("n_name", F.lower(F.trim(F.col("n_nationkey").cast("string"))).alias("k"))
    return a.join(b, "k").select("c_custkey", "n_name")


@query("j06_lookup_join", "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j06(spark, d):
    nation = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


#: Matching blocks by recursion: the longest stretch of x that y holds, earliest in x, then what is left and right of its first place in y.
FUZZY = """with recursive n as (select distinct p_name from part), r as (select a.p_name a, b.p_name b, lower(a.p_name) x, lower(b.p_name) y, 0 m from n a, n b where a.p_name <> b.p_name
    union all select a, b, h.x, h.y, h.m from (select a, b, x, y, list_filter(flatten(list_transform(range(least(length(x), length(y)), 0, -1), lambda l: list_transform(range(1, length(x) - l + 2), lambda i: {'l': l, 'i': i}))), lambda s: contains(y, substr(x, s.i, s.l)))[1] s from r where x <> '' and y <> ''),
        unnest([{'x': substr(x, 1, s.i - 1), 'y': substr(y, 1, instr(y, substr(x, s.i, s.l)) - 1), 'm': s.l}, {'x': substr(x, s.i + s.l), 'y': substr(y, instr(y, substr(x, s.i, s.l)) + s.l), 'm': 0}]) u(h) where s is not null),
    s as (select a, b, 2.0 * sum(m) / (length(a) + length(b)) score from r group by a, b)
    select a p_name, b best, round(score, 6) score from (select *, row_number() over (partition by a order by round(score, 9) desc, b) rn from s) where rn = 1 and score >= 0.55"""


@query("j07_fuzzy_best_match", FUZZY)
def j07(spark, d):
    """Each name's best partner among the others by the ratio of matching blocks, the first by name of equal ones."""
    k = t(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("id"), F.col("p_name").alias("order"), F.lower("p_name").alias("text"))
    return Z.best_matches(k, k, 0.55).select(F.col("id").alias("p_name"), F.col("match").alias("best"), F.round("score", 6).alias("score"))


@query("j17_label_mismatch_pairs", "select a.label la, b.label lb, count(*) n from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label <> b.label group by 1, 2")
def j17(spark, d):
    """Ordered pairs by label, from counts: a pair's order is that of the ids, so each row counts the smaller ids of every other label."""
    e = t(spark, d, "embeddings").select("vec_id", "label")
    labels = [r[0] for r in e.select("label").where("label is not null").distinct().orderBy("label").limit(1001).collect()]
    if len(labels) > 1000:
        raise ValueError("over 1000 classes: one running count a class is too wide")
    if not labels:
        return e.select(F.col("label").alias("la"), F.col("label").alias("lb"), F.lit(0).cast("long").alias("n")).where("false")
    seen = running(e, ["vec_id"], **{f"n{k}": (F.col("label") == k).cast("long") for k in labels})
    long = seen.select(F.col("label").alias("lb"), F.explode(F.array(*(F.struct(F.lit(k).alias("la"), F.col(f"n{k}").alias("n")) for k in labels))).alias("s"))
    return long.where("s.la <> lb").groupBy(F.col("s.la").alias("la"), "lb").agg(F.sum("s.n").alias("n")).where("n > 0")


@query("j20_semi_join", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def j20(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j20_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j20b(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---- aggregates


@query("a01_group_count", "select source, count(*) n from documents group by source")
def a01(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a02_named_aggregates", "select lang, count(distinct source) sources, count(*) docs, sum(n_chars)::bigint chars from documents group by lang")
def a02(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("a03_mean_median_std", "select event_type, round(avg(value), 6) mean, round(median(value), 6) med, round(stddev_samp(value), 6) std, count(*) n from events group by event_type")
def a03(spark, d):
    v = "value"
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("med"), F.round(F.stddev_samp(v), 6).alias("std"), F.count(F.lit(1)).alias("n"))


@query("a04_mean_median_sum", "select o_orderstatus, round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) med, round(sum(o_totalprice), 2) total from orders group by 1")
def a04(spark, d):
    x = "o_totalprice"
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("med"), F.round(F.sum(x), 2).alias("total"))


@query("a05_describe", """select l_returnflag, count(*) n, round(avg(l_extendedprice), 4) mean, round(stddev_samp(l_extendedprice), 4) std, min(l_extendedprice) lo, round(quantile_cont(l_extendedprice, 0.25), 4) q25,
    round(quantile_cont(l_extendedprice, 0.5), 4) q50, round(quantile_cont(l_extendedprice, 0.75), 4) q75, max(l_extendedprice) hi from lineitem group by 1""")
def a05(spark, d):
    x = "l_extendedprice"
    rows = t(spark, d, "lineitem").select("l_returnflag", x)
    out = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    out = out.join(quantiles(rows, x, [0.25, 0.5, 0.75], ["l_returnflag"]), "l_returnflag")
    return out.select("l_returnflag", "n", "mean", "std", "lo", *(F.round(F.col("q")[i], 4).alias(a) for i, a in enumerate(("q25", "q50", "q75"))), "hi")


@query("a06_distinct", "select distinct event_type, user_id % 10 bucket from events")
def a06(spark, d):
    return t(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("a07_value_counts", "select p_brand, count(*) n from part group by 1 order by n desc, p_brand")
def a07(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand")


@query("a08_top_items", "select w, count(*) n from (select unnest(list_distinct(string_split(lower(trim(p_name)), ' '))) w from part) group by 1 order by n desc, w limit 8")
def a08(spark, d):
    w = t(spark, d, "part").select(F.explode(F.array_distinct(F.split(F.lower(F.trim("p_name")), " "))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(8)


@query("a09_crosstab", "select l_returnflag, count(*) filter (l_linestatus = 'F') f, count(*) filter (l_linestatus = 'O') o from lineitem group by 1")
def a09(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("a10_crosstab_margins", "select lang, source, count(*) n, cast(grouping_id(lang, source) as bigint) level from documents group by cube (lang, source)")
def a10(spark, d):
    return t(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("a11_row_shares", "select lang, source, round(n / sum(n) over (partition by lang), 6) share from (select lang, source, count(*) n from documents group by all)")
def a11(spark, d):
    n = t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", "source", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6).alias("share"))


@query("a12_reindex", "select k.lang, coalesce(n, 0) n from (values ('de'), ('en'), ('es'), ('fr'), ('it')) k(lang) left join (select lang, count(*) n from documents group by 1) using (lang)")
def a12(spark, d):
    domain = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    n = t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "lang", "left").na.fill(0, ["n"])


@query("a13_pivot_two_levels", "select o_orderstatus, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice > 200000) urgent_big, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice <= 200000) urgent_small, count(*) filter (o_orderpriority = '5-LOW' and o_totalprice > 200000) low_big from orders group by 1")
def a13(spark, d):
    key = F.concat_ws("|", "o_orderpriority", F.when(F.col("o_totalprice") > 200000, "big").otherwise("small"))
    wide = t(spark, d, "orders").withColumn("k", key).groupBy("o_orderstatus").pivot("k", ["1-URGENT|big", "1-URGENT|small", "5-LOW|big"]).count().na.fill(0)
    return wide.toDF("o_orderstatus", "urgent_big", "urgent_small", "low_big")


@query("a14_unpivot_top", """select k, name, round(x, 6) x from (select s_suppkey k, name, x from (select s_suppkey, s_acctbal::double balance, (s_nationkey * -10)::double nation from supplier) unpivot (x for name in (balance, nation))) order by abs(x) desc, k, name limit 8""")
def a14(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), (F.col("s_nationkey") * -10).cast("double").alias("nation"))
    return s.unpivot("k", ["balance", "nation"], "name", "x").orderBy(F.desc(F.abs("x")), "k", "name").limit(8).withColumn("x", F.round("x", 6))


@query("a15_argmax_per_group", "select source, lang, n, round(n / total, 6) share from (select source, lang, n, sum(n) over (partition by source) total, row_number() over (partition by source order by n desc, lang) rn from (select source, lang, count(*) n from documents group by all)) where rn = 1")
def a15(spark, d):
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"), F.sum("n").alias("total"))
    return best.select("source", F.col("b.lang").alias("lang"), (-F.col("b.m")).alias("n"), F.round(-F.col("b.m") / F.col("total"), 6).alias("share"))


@query("a16_first_per_group", "select user_id, arg_min(event_type, (ts, event_id)) first_type from events group by 1")
def a16(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("a17_ordered_concat", "select conv_id, string_agg(trim(text), ' ' order by turn) filter (trim(text) <> '') full_text from conversations group by 1")
def a17(spark, d):
    rows = t(spark, d, "conversations").where(F.trim("text") != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("x")))).alias("a"))
    return rows.select("conv_id", F.array_join(F.transform("a", lambda s: s["x"]), " ").alias("full_text"))


@query("a18_conditional_rate", "select event_type, round(avg((value > 20)::int), 6) rate from events group by 1")
def a18(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 20).cast("double")), 6).alias("rate"))


@query("a35_resample", "select date_trunc('month', o_orderdate)::date m, round(avg(o_totalprice), 4) mean from orders group by 1")
def a35(spark, d):
    return t(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("a35_last_12_months", "select round(avg(mean), 4) last_12 from (select date_trunc('month', o_orderdate) m, avg(o_totalprice) mean from orders group by 1 order by m desc limit 12)")
def a35b(spark, d):
    monthly = t(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("mean"))
    return monthly.orderBy(F.desc("m")).limit(12).agg(F.round(F.avg("mean"), 4).alias("last_12"))


@query("a36_corpus_summary", """select 'documents' corpus, count(*) n, round(avg(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))), 4) mean_words from documents
    union all select 'conversations', count(*), round(avg(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))), 4) from conversations""")
def a36(spark, d):
    one = lambda name: t(spark, d, name).agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n"), F.round(F.avg(T.word_count(F.col("text"))), 4).alias("mean_words"))
    return one("documents").unionByName(one("conversations"))


@query("a37_composite_index", f"select c_custkey, round((coalesce({GAPS}, 0) + c_nationkey) / ((case when c_custkey % 5 = 0 then 0 else 1 end) + 1), 6) score from customer")
def a37(spark, d):
    a, b = F.expr(GAPS), F.col("c_nationkey").cast("double")
    known = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return t(spark, d, "customer").select("c_custkey", F.round(F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), known), 6).alias("score"))


@query("a38_counts_as_text", "select conv_id, string_agg(role || ':' || n, ', ' order by role) roles from (select conv_id, role, count(*) n from conversations group by all) group by 1")
def a38(spark, d):
    n = t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "role", "n"))), ", ").alias("roles"))


# ---- sorts, limits, top-k, sampling


@query("t01_multi_key_sort", "select n_name, n_regionkey from nation order by n_regionkey, n_name")
def t01(spark, d):
    return t(spark, d, "nation").select("n_name", "n_regionkey").orderBy("n_regionkey", "n_name")


@query("t02_sort_desc_head", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 8")
def t02(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8)


@query("t04_top_column_sums", "select l_suppkey, round(sum(l_quantity), 4) q from lineitem group by 1 order by q desc, l_suppkey limit 12")
def t04(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 4).alias("q")).orderBy(F.desc("q"), "l_suppkey").limit(12)


@query("t06_first_k_per_group", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) rn from documents) where rn <= 8")
def t06(spark, d):
    rn = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return t(spark, d, "documents").select("lang", "doc_id", rn.alias("rn")).where("rn <= 8").select("lang", "doc_id")


@query("t09_pagination", "select page_id, cast(floor((rn - 1) / 5) + 1 as bigint) page_no from (select page_id, row_number() over (order by url, page_id) rn from pages)")
def t09(spark, d):
    return places(t(spark, d, "pages").select("page_id", "url"), "url", "page_id").select("page_id", (F.floor((F.col("place") - 1) / 5) + 1).alias("page_no"))


@query("t10_seeded_sample", f"select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by {draw_sql('doc_id', '42')}, doc_id) rn from documents) where rn <= 20")
def t10(spark, d):
    """Twenty rows a language, by a hash of id and seed: the same on every run and cluster."""
    h = draw(F.col("doc_id"), F.lit(42))
    return t(spark, d, "documents").select("lang", "doc_id", F.row_number().over(W.partitionBy("lang").orderBy(h, "doc_id")).alias("rn")).where("rn <= 20").select("lang", "doc_id")


@query("t11_every_nth", "select vec_id from (select vec_id, row_number() over (order by vec_id) rn from embeddings) where (rn - 1) % 100 = 0")
def t11(spark, d):
    return places(t(spark, d, "embeddings").select("vec_id"), "vec_id").where("(place - 1) % 100 = 0").select("vec_id")


@query("t14_hash_split", f"select doc_id, case when {draw_sql('doc_id', '7')} % 10 < 2 then 'test' else 'train' end part from documents")
def t14(spark, d):
    part = draw(F.col("doc_id"), F.lit(7)) % 10
    return t(spark, d, "documents").select("doc_id", F.when(part < 2, "test").otherwise("train").alias("part"))


@query("t14_stratified_split", "select lang, doc_id, case when rn <= round(0.2 * n) then 'test' else 'train' end part from (select lang, doc_id, row_number() over (partition by lang order by doc_id) rn, count(*) over (partition by lang) n from documents)")
def t14b(spark, d):
    rn, n = F.row_number().over(W.partitionBy("lang").orderBy("doc_id")), F.count(F.lit(1)).over(W.partitionBy("lang"))
    return t(spark, d, "documents").select("lang", "doc_id", F.when(rn <= F.round(0.2 * n), "test").otherwise("train").alias("part"))


@query("t15_stratified_folds", "select doc_id, (row_number() over (partition by lang order by doc_id) - 1) % 5 fold from documents")
def t15(spark, d):
    return t(spark, d, "documents").select("doc_id", ((F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1) % 5).cast("long").alias("fold"))


# ---- set operations


@query("u01_union_all", "select doc_id id, lang, null::varchar role from documents union all select conv_id, null, role from conversations")
def u01(spark, d):
    a = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    b = t(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role")
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_union_distinct", "select c_nationkey k from customer union select s_nationkey from supplier")
def u02(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u03_array_overlap", "select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'ring'])")
def u03(spark, d):
    return t(spark, d, "part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey")


@query("u04_unique", "select distinct p_brand, p_type from part")
def u04(spark, d):
    return t(spark, d, "part").select("p_brand", "p_type").dropDuplicates()


@query("u05_token_intersection", "select doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')), ['the', 'and', 'of', 'to', 'is'])) n from documents")
def u05(spark, d):
    marks = F.array(*map(F.lit, ("the", "and", "of", "to", "is")))
    return t(spark, d, "documents").select("doc_id", F.size(F.array_intersect(T.tokens(F.col("text")), marks)).cast("long").alias("n"))


@query("u06_labels_without_noise", "select count(distinct case when label - 1 <> -1 then label - 1 end) n_labels from embeddings")
def u06(spark, d):
    return t(spark, d, "embeddings").select((F.col("label") - 1).alias("k")).agg(F.count_distinct(F.when(F.col("k") != -1, F.col("k"))).alias("n_labels"))


@query("u07_except", "select c_nationkey k from customer except select s_nationkey from supplier where s_acctbal > 5000")
def u07(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
