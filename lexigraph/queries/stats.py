"""Statistical tests, agreement, monitoring and permutation queries."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import stats as S
from lexigraph.functions import vec as V
from lexigraph.operators import geometry as geo
from lexigraph.operators import sequences as seqs
from lexigraph.operators.order import places, quantiles, running

from .base import draw, draw_sql, query, t
from .vectors import EDGES, KIND, U, E, P, seq, transitions, units

#: z and p of obs(o) against nul(m), as `verdict`.
VERDICT = "select round(max(o), 6) observed, round(avg(m), 6) mu, round((max(o) - avg(m)) / nullif(stddev_pop(m), 0), 6) z, round(avg((m >= o)::int), 6) p_one, round((count(*) filter (m >= o) + 1) / (count(*) + 1), 6) p_plus from nul, obs"
GAP = "avg((sim < 0.05)::int) filter (kind <> kind2) - avg((sim < 0.05)::int) filter (kind = kind2)"


def permuted_sql(rows: str, group: str, order: str, label: str, n: int) -> str:
    """perm(perm, group, order, label), as `permuted`."""
    here = f"select perm, {group}, {order}, row_number() over (partition by perm, {group} order by {order}) k from {rows}, range(1, {n + 1}) x(perm)"
    there = f"select perm, {group}, {label} moved, row_number() over (partition by perm, {group} order by {draw_sql(order, 'perm')}, {order}) k from {rows}, range(1, {n + 1}) x(perm)"
    return f"perm as (select h.perm, h.{group}, h.{order}, moved from ({here}) h join ({there}) w using (perm, {group}, k))"



def crosstab(spark, d):
    """(r, c, o, e): observed and expected counts of lang by toxic-or-not source class, zero cells included."""
    n = t(spark, d, "events").groupBy(F.col("event_type").alias("r"), (F.col("user_id") % 4).alias("c")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = n.groupBy("r").agg(F.sum("o").alias("nr")), n.groupBy("c").agg(F.sum("o").alias("nc"))
    total = n.agg(F.sum("o").alias("n"))
    cells = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total)).join(n, ["r", "c"], "left").na.fill(0, ["o"])
    return cells.select("r", "c", "o", (F.col("nr") * F.col("nc") / F.col("n")).alias("e"))


CROSS = """n as (select event_type r, user_id % 4 c, count(*) o from events group by all), k as (select r, c, coalesce(o, 0) o, (select sum(o) from n x where x.r = a.r) * (select sum(o) from n x where x.c = b.c)::double / (select sum(o) from n) e
    from (select distinct r from n) a cross join (select distinct c from n) b left join n using (r, c))"""


@query("i01_chi_square", f"with {CROSS} select round(sum((o - e) ** 2 / e), 6) chi2, (count(distinct r) - 1) * (count(distinct c) - 1) dof, sum(o)::bigint n from k")
def i01(spark, d):
    return crosstab(spark, d).agg(F.round(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")), 6).alias("chi2"), ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("dof"), F.sum("o").alias("n"))


@query("i01_chi_square_p")
def i01p(spark, d):
    r = i01(spark, d).first()
    return spark.createDataFrame([(r["chi2"], r["dof"], round(S.chi2_tail(r["chi2"], r["dof"]), 6))], "chi2 double, dof long, p double")


@query("i02_pearson_residuals", f"with {CROSS} select r, c, round((o - e) / sqrt(e), 6) z from k")
def i02(spark, d):
    return crosstab(spark, d).select("r", "c", F.round((F.col("o") - F.col("e")) / F.sqrt("e"), 6).alias("z"))


@query("t07_largest_residuals", f"with {CROSS} select r, c, round((o - e) / sqrt(e), 6) z from k where abs((o - e) / sqrt(e)) > 1 order by abs(round((o - e) / sqrt(e), 6)) desc, r, c")
def t07(spark, d):
    z = i02(spark, d)
    return z.where(F.abs("z") > 1).orderBy(F.desc(F.abs("z")), "r", "c")


TWO = "g as (select event_type = 'click' a, value x from events where event_type in ('click', 'view')), m as (select avg(x) filter (a) ma, avg(x) filter (not a) mb, var_samp(x) filter (a) va, var_samp(x) filter (not a) vb, count(*) filter (a) na, count(*) filter (not a) nb from g), q as (select *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) sp from m)"


def two_samples(spark, d):
    x, a = F.col("value"), F.col("event_type") == "click"
    e = t(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    m = e.agg(F.avg(F.when(a, x)).alias("ma"), F.avg(F.when(~a, x)).alias("mb"), F.var_samp(F.when(a, x)).alias("va"), F.var_samp(F.when(~a, x)).alias("vb"), F.count(F.when(a, x)).alias("na"), F.count(F.when(~a, x)).alias("nb"))
    return m.withColumn("sp", F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)))


@query("i03_t_test", f"with {TWO} select round((ma - mb) / (sp * sqrt(1 / na + 1 / nb)), 6) t, na + nb - 2 dof from q")
def i03(spark, d):
    return two_samples(spark, d).select(F.round((F.col("ma") - F.col("mb")) / (F.col("sp") * F.sqrt(1 / F.col("na") + 1 / F.col("nb"))), 6).alias("t"), (F.col("na") + F.col("nb") - 2).alias("dof"))


@query("i03_t_test_p")
def i03p(spark, d):
    r = i03(spark, d).first()
    return spark.createDataFrame([(r["t"], r["dof"], round(S.t_tail(r["t"], r["dof"]), 6))], "t double, dof long, p double")


@query("i04_cohens_d", f"with {TWO} select round((ma - mb) / sp, 6) d from q")
def i04(spark, d):
    return two_samples(spark, d).select(F.round((F.col("ma") - F.col("mb")) / F.col("sp"), 6).alias("d"))


#: Shares of Poisson(1) up to 0, 1, ... 6; a weight is the first whose share the draw is below, or 7.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]


@query("i05_bootstrap_means", f"""with e as (select event_type, b, value, ({draw_sql('event_id', 'b')} % {1 << 30} + 0.5::double) / {1 << 30} u from events, range(1, 201) x(b)),
    w as (select event_type, b, value, case {' '.join(f'when u < {c!r}::double then {k}' for k, c in enumerate(POISSON))} else 7 end w from e),
    m as (select event_type, sum(w * value) / nullif(sum(w), 0) m from w group by event_type, b)
    select event_type, round(avg(m), 6) mean, round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi from m group by 1""")
def i05(spark, d):
    """Poisson bootstrap of the mean by event type: every row draws its weight for each replicate from a hash, so replicates are aggregates and no row is indexed."""
    u = (draw(F.col("event_id"), F.col("b")) % (1 << 30) + 0.5) / (1 << 30)
    e = t(spark, d, "events").select("event_type", "event_id", "value", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b")).withColumn("u", u)
    weight = F.lit(7)
    for k, c in reversed(list(enumerate(POISSON))):
        weight = F.when(F.col("u") < c, k).otherwise(weight)
    means = e.withColumn("w", weight).groupBy("event_type", "b").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(q[0], 6).alias("lo"), F.round(q[1], 6).alias("hi"))


@query("t12_bootstrap_sample", f"with s as (select s_suppkey, row_number() over (order by s_suppkey) k from supplier), n as (select count(*) n from s) select draw, s_suppkey from (select d.i as draw, {draw_sql('d.i', '42')} % n + 1 k from n, range((select n from n)) d(i)) join s using (k)")
def t12(spark, d):
    """One resample with replacement of the suppliers: draws by hash of their number, joined on the row number."""
    s = places(t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", out="k")
    n = s.count()
    draws = spark.range(n).select(F.col("id").alias("draw"), (draw(F.col("id"), F.lit(42)) % max(1, n) + 1).alias("k"))
    return draws.join(s, "k").select("draw", "s_suppkey")


@query("t13_permutation_within_group", f"""select conv_id, turn, role, permuted from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) k from conversations)
    join (select conv_id, role as permuted, row_number() over (partition by conv_id order by {draw_sql('turn', '1')}, turn) k from conversations) using (conv_id, k)""")
def t13(spark, d):
    """Labels permuted within each conversation by rank of a hash."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    here = c.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    there = c.select("conv_id", F.col("role").alias("permuted"), F.row_number().over(W.partitionBy("conv_id").orderBy(draw(F.col("turn"), F.lit(1)), "turn")).alias("k"))
    return here.join(there, ["conv_id", "k"]).select("conv_id", "turn", "role", "permuted")


def permuted(df, group, order, label, n):
    """(perm, group, order, label): label permuted within groups, for permutations 1 to n."""
    p = df.select(group, order, label).crossJoin(F.broadcast(df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("perm"))))
    here = p.select("perm", group, order, F.row_number().over(W.partitionBy("perm", group).orderBy(order)).alias("k"))
    there = p.select("perm", group, label, F.row_number().over(W.partitionBy("perm", group).orderBy(draw(F.col(order), F.col("perm")), order)).alias("k"))
    return here.join(there, ["perm", group, "k"]).drop("k")


def verdict(null, observed, value):
    """z and p of an observed value against a null distribution (perm, value)."""
    o = observed.select(F.col(value).alias("obs"))
    m = null.crossJoin(F.broadcast(o))
    a = m.agg(F.max("obs").alias("observed"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.avg((F.col(value) >= F.col("obs")).cast("double")).alias("p_one"), F.count(F.lit(1)).alias("n"), F.sum((F.col(value) >= F.col("obs")).cast("long")).alias("above"))
    return a.select(F.round("observed", 6).alias("observed"), F.round("mu", 6).alias("mu"), F.round(F.try_divide(F.col("observed") - F.col("mu"), F.col("sd")), 6).alias("z"), F.round("p_one", 6).alias("p_one"), F.round((F.col("above") + 1) / (F.col("n") + 1), 6).alias("p_plus"))


def gap(rows, keys):
    x, same = (F.col("sim") < 0.05).cast("double"), F.col("kind") == F.col("kind2")
    return rows.groupBy(*keys).agg((F.avg(F.when(~same, x)) - F.avg(F.when(same, x))).alias("gap"))


@query("i06_order_null_model", f"""with {E}, {P}, f as (select label, vec_id, min(q) fb from p where sim < 0 group by all), obs as (select avg(coalesce(fb, n + 1) - pos - 1) o from e left join f using (label, vec_id)),
    {permuted_sql('e', 'label', 'pos', 'vec_id', 20)}, b as (select label, vec_id a, vec2 b from p where sim < 0 union all select label, vec2, vec_id from p where sim < 0),
    fb as (select x.perm, x.label, x.pos, min(y.pos) fb from perm x join b on b.label = x.label and b.a = x.moved join perm y on y.perm = x.perm and y.label = x.label and y.moved = b.b and y.pos > x.pos group by all),
    sizes as (select label, count(*) n from e group by 1), nul as (select perm, avg(coalesce(fb, n + 1) - pos - 1) m from perm join sizes using (label) left join fb using (perm, label, pos) group by 1) {VERDICT}""")
def i06(spark, d):
    """Mean attention window against that of shuffled orders of each group."""
    e = seq(spark, d)
    observed = seqs.attention_windows(e, [0.0]).agg(F.avg("window").alias("m"))
    perm = permuted(e.select("g", "pos", "id"), "g", "pos", "id", 20)
    # each shuffled group is a sequence of its own, scanned forward like the observed ones
    shuffled = perm.join(e.select("g", "id", "u"), ["g", "id"]).select(F.concat_ws("/", "perm", "g").alias("g"), "id", "pos", "u")
    w = seqs.attention_windows(shuffled, [0.0]).select(F.substring_index("g", "/", 1).cast("long").alias("perm"), "window")
    return verdict(w.groupBy("perm").agg(F.avg("window").alias("m")), observed, "m")


@query("i07_permute_labels", f"""with {KIND}, obs as (select {GAP} o from a where sim is not null), {permuted_sql('e', 'label', 'pos', 'kind', 200)},
    s as (select x.perm, x.moved kind, y.moved kind2, sim from perm x join perm y on x.perm = y.perm and x.label = y.label and y.pos = x.pos + 1 join a on a.label = x.label and a.pos = x.pos where sim is not null),
    nul as (select perm, {GAP} m from s group by 1) {VERDICT}""")
def i07(spark, d):
    """Null of the split-rate gap: labels shuffled within groups."""
    base = transitions(spark, d)
    sims = base.select("g", "pos", "sim")
    kinds = seq(spark, d).select("g", "pos", (F.col("id") % 3).alias("kind"))
    p = permuted(kinds, "g", "pos", "kind", 200)
    nxt = p.select("perm", "g", (F.col("pos") - 1).alias("pos"), F.col("kind").alias("kind2"))
    return verdict(gap(p.join(nxt, ["perm", "g", "pos"]).join(sims, ["g", "pos"]), ["perm"]), gap(base, []), "gap")


@query("i08_permute_order", f"""with {KIND}, obs as (select {GAP} o from a where sim is not null), spots as (select *, pos as place from e), {permuted_sql('spots', 'label', 'pos', 'place', 50)},
    s as (select x.perm, f.kind, g.kind kind2, list_cosine_similarity(f.v, g.v) sim from perm x join perm y on x.perm = y.perm and x.label = y.label and y.pos = x.pos + 1
    join e f on f.label = x.label and f.pos = x.moved join e g on g.label = x.label and g.pos = y.moved), nul as (select perm, {GAP} m from s group by 1) {VERDICT}""")
def i08(spark, d):
    """Null of the split-rate gap: rows shuffled within groups. Rows next to each other in a shuffled order meet there; no other pairs are made."""
    e = t(spark, d, "embeddings").where("label is not null")
    at = e.select(F.col("label").alias("g"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long").alias("pos"), (F.col("vec_id") % 3).alias("kind"), F.col("embedding").alias("v"))
    p = at.crossJoin(F.broadcast(spark.range(1, 51).select(F.col("id").cast("int").alias("perm")))).withColumn("draw", draw(F.col("pos"), F.col("perm")))
    w = W.partitionBy("perm", "g").orderBy("draw", "pos")
    step = p.select("perm", "pos", "kind", "v", F.lead("pos").over(w).alias("pos2"), F.lead("kind").over(w).alias("kind2"), F.lead("v").over(w).alias("v2")).where("pos2 is not null")
    rows = step.select("perm", "kind", "kind2", V.dot(V.unit(V.doubles(F.col("v"))), V.unit(V.doubles(F.col("v2")))).alias("sim"))
    return verdict(gap(rows, ["perm"]), gap(transitions(spark, d), []), "gap")


@query("i09_permute_graph_labels", f"""{EDGES}, l as (select 0 one, vec_id, label from u), {permuted_sql('l', 'one', 'vec_id', 'label', 50)},
    obs as (select avg((a.label <> b.label)::int) o from g join l a on a.vec_id = src join l b on b.vec_id = dst),
    nul as (select a.perm, avg((a.moved <> b.moved)::int) m from g join perm a on a.vec_id = src join perm b on b.vec_id = dst and a.perm = b.perm group by 1) {VERDICT}""")
def i09(spark, d):
    """Null of the cross-label share of the neighbour graph's edges."""
    e = units(spark, d)
    edges = geo.knn_graph(e, 5)
    labels = e.select(F.lit(0).alias("one"), "id", "label")
    share = lambda l, keys: edges.join(l.select(*keys, F.col("id").alias("src"), F.col("label").alias("a")), "src").join(l.select(*keys, F.col("id").alias("dst"), F.col("label").alias("b")), [*keys, "dst"]).groupBy(*keys).agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("x"))  # noqa: E731, E741
    return verdict(share(permuted(labels, "one", "id", "label", 50), ["perm"]), share(labels, []), "x")


@query("i10_mann_whitney", """with r as (select event_type, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 rk, count(*) over (partition by value) tie from events where event_type in ('click', 'view')),
    s as (select sum(rk) filter (event_type = 'click') ra, count(*) filter (event_type = 'click') na, count(*) filter (event_type = 'view') nb, sum((tie * tie - 1)::double) ties, count(*) n from r)
    select round(ra - na * (na + 1) / 2, 4) u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) z from s""")
def i10(spark, d):
    e = t(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_type", "value")
    ties = e.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("ties"))
    a = F.col("event_type") == "click"
    s = S.average_rank(e, "value", "r").agg(F.sum(F.when(a, F.col("r"))).alias("ra"), F.count(F.when(a, 1)).alias("na"), F.count(F.when(~a, 1)).alias("nb"), F.count(F.lit(1)).alias("n")).crossJoin(ties)
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    return s.select(F.round(u, 4).alias("u"), F.round((u - F.col("na") * F.col("nb") / 2) / F.sqrt(F.col("na") * F.col("nb") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))), 6).alias("z"))


@query("i11_ks_two_sample", """with v as (select value, count(*) filter (event_type = 'click') a, count(*) filter (event_type = 'view') b from events where event_type in ('click', 'view') group by 1),
    c as (select sum(a) over (order by value) / sum(a) over () fa, sum(b) over (order by value) / sum(b) over () fb from v) select round(max(abs(fa - fb)), 6) ks from c""")
def i11(spark, d):
    a = F.col("event_type") == "click"
    v = t(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("value").agg(F.count(F.when(a, 1)).alias("a"), F.count(F.when(~a, 1)).alias("b"))
    total = v.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = running(v, ["value"], ca=F.col("a"), cb=F.col("b")).select("ca", "cb").crossJoin(F.broadcast(total))
    return c.agg(F.round(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))), 6).alias("ks"))


@query("i12_spearman", """with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2 b from part) select round(corr(a, b), 6) rho from r""")
def i12(spark, d):
    p = t(spark, d, "part").select("p_size", "p_retailprice")
    r = S.average_rank(S.average_rank(p, "p_size", "a"), "p_retailprice", "b")
    return r.select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("i13_pearson", "select round(corr(l_quantity, l_extendedprice), 6) r from lineitem")
def i13(spark, d):
    return t(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("a33_correlations", "select round(corr(l_quantity, l_discount), 6) qd, round(corr(l_quantity, l_tax), 6) qt, round(corr(l_discount, l_tax), 6) dt from lineitem")
def a33(spark, d):
    c = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return t(spark, d, "lineitem").agg(c("l_quantity", "l_discount", "qd"), c("l_quantity", "l_tax", "qt"), c("l_discount", "l_tax", "dt"))


@query("a34_guarded_correlation", "select event_type, 0.0::double r_constant, round(corr(value, user_id), 6) r from events group by 1")
def a34(spark, d):
    e = t(spark, d, "events").select("event_type", "value", F.col("user_id").cast("double").alias("u"), F.lit(3.0).alias("k"))
    return e.groupBy("event_type").agg(F.round(S.safe_corr("value", "k"), 6).alias("r_constant"), F.round(S.safe_corr("value", "u"), 6).alias("r"))


@query("i14_geometry_agreement", f"with {U}, h as (select vec_id, u[1:32] a, u[33:64] b from u), p as (select list_cosine_similarity(x.a, y.a) s, list_cosine_similarity(x.b, y.b) z from h x join h y on x.vec_id < y.vec_id) select round(corr(s, z), 6) r, count(*) n from p")
def i14(spark, d):
    e = t(spark, d, "embeddings")
    half = lambda at: V.unit(V.doubles(F.slice("embedding", at, 32)))
    h = e.where("embedding is not null and vec_id is not null").select(F.col("vec_id").alias("id"), half(1).alias("a"), half(33).alias("b"))
    m = geo.pair_moments(h, "a", "b")
    n = h.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2, F.lit(0)).cast("long").alias("pairs"))
    k, x, y = F.col("n"), F.col("sx"), F.col("sy")
    # sums of equal similarities differ in their last digits
    vx, vy = (F.when(v > 1e-12 * k * ss, v) for v, ss in ((k * F.col("sxx") - x * x, F.col("sxx")), (k * F.col("syy") - y * y, F.col("syy"))))
    return m.crossJoin(n).select(F.round(F.try_divide(k * F.col("sxy") - x * y, F.sqrt(vx) * F.sqrt(vy)), 6).alias("r"), F.col("pairs").alias("n"))


@query("i15_axis_robustness")
def i15(spark, d):
    """Spearman's rho of axis projections on vector prefixes against those on whole vectors."""
    from .vectors import axis

    e = t(spark, d, "embeddings")
    whole = None
    for k in (64, 32, 16, 8):
        u = geo.units(e.withColumn("head", F.slice("embedding", 1, k)), "vec_id", "head", "label")
        p = u.crossJoin(F.broadcast(axis(u))).select("id", V.dot(F.col("u"), F.col("axis")).alias(f"p{k}"))
        whole = p if whole is None else whole.join(p, "id")
    for k in (64, 32, 16, 8):
        whole = S.average_rank(whole, f"p{k}", f"r{k}")
    return whole.agg(*(F.round(F.corr(F.col("r64").cast("double"), F.col(f"r{k}").cast("double")), 6).alias(f"rho{k}") for k in (32, 16, 8)))


@query("i16_simple_regression", "select round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 from lineitem")
def i16(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return t(spark, d, "lineitem").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("i21_kappa", """with s as (select unnest(['all', lang]) stratum, quality = 0 a, toxic = 1 b from labels join documents using (doc_id)), k as (select stratum, count(*) n, avg((a = b)::int) po, avg(a::int) pa, avg(b::int) pb from s group by 1)
    select stratum, n, round(po, 6) agreement, round(case when pa * pb + (1 - pa) * (1 - pb) = 1 then 0 else (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end, 6) kappa from k where n >= 5""")
def i21(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    s = j.select(F.explode(F.array(F.lit("all"), F.col("lang"))).alias("stratum"), (F.col("quality") == 0).cast("double").alias("a"), (F.col("toxic") == 1).cast("double").alias("b"))
    k = s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb")).where("n >= 5")
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return k.select("stratum", "n", F.round("po", 6).alias("agreement"), F.round(F.coalesce(F.try_divide(F.col("po") - pe, 1 - pe), F.lit(0.0)), 6).alias("kappa"))


@query("i22_invariance", "with m as (select source, avg(n_chars) x from documents group by 1) select round(avg(x), 4) mean, round(stddev_samp(x), 4) std, round(stddev_samp(x) / avg(x), 6) cv, bool_and(x > 0) all_positive, bool_and(x >= 1500) all_large from m")
def i22(spark, d):
    m = t(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("x"))
    return m.agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.round(F.stddev_samp("x") / F.avg("x"), 6).alias("cv"), F.every(F.col("x") > 0).alias("all_positive"), F.every(F.col("x") >= 1500).alias("all_large"))


CONT = "n as (select event_type a, user_id % 5 b, count(*)::double n from events group by all), ra as (select a, sum(n) n from n group by 1), rb as (select b, sum(n) n from n group by 1), tt as (select sum(n) t from n)"


@query("i23_ari_nmi", f"with {CONT}, s as (select (select sum(n * (n - 1) / 2) from n) ij, (select sum(n * (n - 1) / 2) from ra) i, (select sum(n * (n - 1) / 2) from rb) j, t * (t - 1) / 2 c, t from tt), h as (select (select -sum(n / t * ln(n / t)) from ra, tt) ha, (select -sum(n / t * ln(n / t)) from rb, tt) hb, (select sum(n.n / t * ln(n.n * t / (ra.n * rb.n))) from n join ra using (a) join rb using (b), tt) mi) select round((ij - i * j / c) / ((i + j) / 2 - i * j / c), 6) ari, round(mi / ((ha + hb) / 2), 6) nmi from s, h")
def i23(spark, d):
    n = t(spark, d, "events").groupBy(F.col("event_type").alias("a"), (F.col("user_id") % 5).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    total = n.agg(F.sum("n").alias("t"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    h = lambda df, c, name: df.crossJoin(F.broadcast(total)).agg(two(c).alias(f"c{name}"), (-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(f"h{name}"))
    mi = n.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total)).agg(two("n").alias("ij"), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.max("t").alias("t"))
    s = mi.crossJoin(h(ra, "na", "a")).crossJoin(h(rb, "nb", "b")).withColumn("e", F.col("ca") * F.col("cb") / (F.col("t") * (F.col("t") - 1) / 2))
    return s.select(F.round((F.col("ij") - F.col("e")) / ((F.col("ca") + F.col("cb")) / 2 - F.col("e")), 6).alias("ari"), F.round(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2), 6).alias("nmi"))


@query("i24_silhouette", f"with {U}, p as (select a.vec_id i, a.label li, b.label lj, avg(1 - list_dot_product(a.u, b.u)) m from u a join u b on a.vec_id <> b.vec_id group by all), s as (select i, min(m) filter (li = lj) a, min(m) filter (li <> lj) b from p group by 1) select round(avg((b - a) / greatest(a, b)), 6) silhouette from s")
def i24(spark, d):
    """Cosine silhouette from group sums: the mean distance of a point to a group is 1 less its dot product with the group's sum over its size, so no pairs are formed."""
    e = units(spark, d)
    g = geo.group_sums(e, "label").select(F.col("label").alias("lj"), "n", "s")
    x = e.crossJoin(F.broadcast(g)).select("id", "label", "lj", "n", V.dot(F.col("u"), F.col("s")).alias("dp"), V.dot(F.col("u"), F.col("u")).alias("uu"))
    own = F.col("label") == F.col("lj")
    m = F.when(own, F.try_divide(F.col("n") - 1 - (F.col("dp") - F.col("uu")), (F.col("n") - 1).cast("double"))).otherwise(1 - F.col("dp") / F.col("n"))
    s = x.withColumn("m", m).groupBy("id").agg(F.min(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return s.agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"))


@query("i25_davies_bouldin", f"with {U}, c as (select label, list(x order by i) c from (select label, i, avg(x) x from (select label, unnest(u) x, unnest(generate_series(1, len(u))) i from u) group by all) group by 1), s as (select label, any_value(c) c, avg(list_distance(u, c)) s, sum(list_distance(u, c) ** 2) w from u join c using (label) group by 1), r as (select a.label, max((a.s + b.s) / list_distance(a.c, b.c)) r from s a join s b on a.label <> b.label group by 1) select round(avg(r), 6) db, (select round(sum(w), 4) from s) inertia from r")
def i25(spark, d):
    e = units(spark, d)
    c = V.mean_vector(e, ["label"], "u", "c")
    dist = lambda a, b: V.norm(V.minus(a, b))
    x = e.join(F.broadcast(c), "label").select("label", "c", dist(F.col("u"), F.col("c")).alias("x"))
    s = x.groupBy("label").agg(F.first("c").alias("c"), F.avg("x").alias("s"), F.sum(F.col("x") ** 2).alias("w"))
    b = s.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    r = s.crossJoin(F.broadcast(b)).where("label <> l2").groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / dist(F.col("c"), F.col("c2"))).alias("r"), F.max("w").alias("w"))
    return r.agg(F.round(F.avg("r"), 6).alias("db"), F.round(F.sum("w"), 4).alias("inertia"))


@query("i26_psi", """with q as (select quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) q from lineitem where l_orderkey % 2 = 0), x as (select l_orderkey % 2 = 0 a, l_quantity v from lineitem),
    b as (select a, case when v < q[1] or v > q[6] then null when v < q[2] then 1 when v < q[3] then 2 when v < q[4] then 3 when v < q[5] then 4 else 5 end k from x, q), n as (select k, count(*) filter (a)::double / (select count(*) from x where a) e, count(*) filter (not a)::double / (select count(*) from x where not a) o from b where k is not null group by 1)
    select round(sum((o - e) * ln(o / e)), 6) psi from n""")
def i26(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_orderkey") % 2 == 0).alias("a"), F.col("l_quantity").alias("v"))
    q = quantiles(x.where("a"), "v", [k / 5 for k in range(6)])
    v, e = F.col("v"), F.col("q")
    k = F.when((v < e[0]) | (v > e[5]), None).when(v < e[1], 1).when(v < e[2], 2).when(v < e[3], 3).when(v < e[4], 4).otherwise(5)
    total = x.agg(F.count(F.when(F.col("a"), 1)).alias("na"), F.count(F.when(~F.col("a"), 1)).alias("nb"))
    n = x.crossJoin(F.broadcast(q)).withColumn("k", k).where("k is not null").groupBy("k").agg(F.count(F.when(F.col("a"), 1)).alias("ca"), F.count(F.when(~F.col("a"), 1)).alias("cb")).crossJoin(F.broadcast(total))
    e2, o2 = F.col("ca") / F.col("na"), F.col("cb") / F.col("nb")
    return n.agg(F.round(F.sum((o2 - e2) * F.ln(o2 / e2)), 6).alias("psi"))


@query("i31_period_drift", f"with {U}, p as (select *, ntile(3) over (order by vec_id) third from u), c as (select third, list(x order by i) c from (select third, i, avg(x) x from (select third, unnest(u) x, unnest(generate_series(1, len(u))) i from p) group by all) group by 1) select i, round(b.x - a.x, 6) drift from (select unnest(c) x, unnest(generate_series(1, 64)) i from c where third = 1) a join (select unnest(c) x, unnest(generate_series(1, 64)) i from c where third = 3) b using (i) order by abs(round(b.x - a.x, 6)) desc, i limit 10")
def i31(spark, d):
    e = units(spark, d)
    n = e.count()
    # thirds by place; the first ones are one longer where the count is no multiple
    long_, size = n % 3, n // 3
    place = F.col("place")
    third = F.when(place <= long_ * (size + 1), F.floor((place - 1) / (size + 1))).otherwise(long_ + F.floor((place - 1 - long_ * (size + 1)) / max(1, size))) + 1
    e = places(e, "id").withColumn("third", third)
    c = V.mean_vector(e.where("third in (1, 3)"), ["third"], "u", "c")
    p = c.agg(F.max(F.when(F.col("third") == 1, F.col("c"))).alias("a"), F.max(F.when(F.col("third") == 3, F.col("c"))).alias("b"))
    x = p.select(F.posexplode(V.minus(F.col("b"), F.col("a"))).alias("k", "x")).select((F.col("k") + 1).cast("long").alias("i"), F.round("x", 6).alias("drift"))
    return x.orderBy(F.desc(F.abs("drift")), "i").limit(10)


@query("i32_alerts", "select event_type, count(*) n, stddev_pop(value) < 1e-6 constant, max(value) > avg(value) + 3 * stddev_pop(value) outliers, count(*) < 30 thin from events group by 1")
def i32(spark, d):
    v = "value"
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop(v) < 1e-6).alias("constant"), (F.max(v) > F.avg(v) + 3 * F.stddev_pop(v)).alias("outliers"), (F.count(F.lit(1)) < 30).alias("thin"))


@query("a41_segment_error", "select l_returnflag, round(100 * avg(abs((l_extendedprice - l_quantity * 1500) / l_extendedprice)), 4) mape from lineitem group by 1")
def a41(spark, d):
    ape = F.abs((F.col("l_extendedprice") - F.col("l_quantity") * 1500) / F.col("l_extendedprice"))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 * F.avg(ape), 4).alias("mape"))


@query("a42_batch_monitoring", "select event_type, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(max(value) - min(value), 6) width, round(quantile_cont(value, 0.05), 6) p05, round(median(value), 6) med, round(quantile_cont(value, 0.95), 6) p95 from events group by 1")
def a42(spark, d):
    v = "value"
    rows = t(spark, d, "events").select("event_type", v)
    m = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.max(v) - F.min(v), 6).alias("width"))
    m = m.join(quantiles(rows, v, [0.05, 0.5, 0.95], ["event_type"]), "event_type")
    return m.select("event_type", "n", "mean", "std", "width", *(F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("p05", "med", "p95"))))
