"""Event-time extensions over `events`, and site queries over `pages` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigraph.streaming import recent as R
from lexigraph.streaming import windows as S

from .base import query, t


def events(spark, d):
    return S.event_time(t(spark, d, "events"))


@query("z01_tumbling_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def z01(spark, d):
    return S.tumbling(events(spark, d), "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("z02_sliding_windows", "select s as start, count(*) n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) s from events) group by 1")
def z02(spark, d):
    w = events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("z03_session_windows", """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes' then 0 else 1 end b, event_id from events), s as (select *, sum(b) over (partition by user_id order by ts, event_id) k from g)
    select user_id, min(ts) as start, count(*) n from s group by user_id, k""")
def z03(spark, d):
    w = events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("z04_stream_totals", "select event_type, count(*) n, round(sum(value), 2) total from events group by 1")
def z04(spark, d):
    """The tumbling windows as a stream with a watermark, run to the end of what is there, then summed."""
    table = t(spark, d, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    windows = S.event_time(stream).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = S.run_to_end(spark, windows.select("event_type", "n", "total"), "append")
    # the last windows stay open until a later event passes the watermark; their rows are added from the batch side
    last = S.event_time(table).agg((F.max("ts") - F.expr("interval 1 hour")).alias("m"))
    open_rows = S.event_time(table).crossJoin(F.broadcast(last)).where(F.window("ts", "1 hour").getField("end") > F.col("m")).select("event_type", F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    return out.union(open_rows).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("z05_stream_dedup", "select count(*) n from (select distinct event_id from events)")
def z05(spark, d):
    table = t(spark, d, "events")
    stream = S.event_time(spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*"))
    twice = stream.withWatermark("ts", "1 hour").select("event_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return S.run_to_end(spark, twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id")).agg(F.count(F.lit(1)).alias("n"))


@query("z06_last_rows_drift", """with r as (select event_type k, value, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events where value is not null), q as (select k, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) q, count(*) total from r group by 1),
    b as (select k, rn, (value >= q[1])::int + (value >= q[2])::int + (value >= q[3])::int + (value >= q[4])::int bin, total from r join q using (k)), s as (select k, least(any_value(total), 1000) n, any_value(total) total from b group by 1),
    c as (select k, u.bin, coalesce(nullif(count(*) filter (b.bin = u.bin), 0), 0.5) / any_value(total) e, coalesce(nullif(count(*) filter (b.bin = u.bin and rn <= 1000), 0), 0.5) / any_value(n) o from b join s using (k, total), unnest(range(0, 5)) u(bin) group by 1, 2)
    select k event_type, any_value(n)::bigint n, round(sum((o - e) * ln(o / e)), 6) psi from c join s using (k) group by 1""")
def z06(spark, d):
    """Drift of each type's last 1000 events, as a stream keeps them, against all of its events."""
    table = t(spark, d, "events")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    kept = R.merged(R.states(spark, lambda: R.last_rows(stream, "event_type", "ts", "event_id", "value")))
    reference = table.select(F.col("event_type").alias("key"), "value").where("value is not null")
    return R.drift(kept, reference).select(F.col("key").alias("event_type"), "n", F.round("psi", 6).alias("psi"))


@query("a39_term_counts", "select term, count(*) n from (select unnest(string_split(p_name, ' ')) term from part) group by 1 order by term")
def a39(spark, d):
    return t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy("term")


@query("a40_archive", "select year(o_orderdate) y, month(o_orderdate) m, count(*) n from orders group by rollup (1, 2)")
def a40(spark, d):
    return t(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).rollup("y", "m").agg(F.count(F.lit(1)).alias("n"))


@query("t08_latest", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 8")
def t08(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(8).select("o_orderkey")
