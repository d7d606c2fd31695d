"""Clustering, topics, dimensionality and supervised learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import stats as S
from lexigraph.functions import text as T
from lexigraph.functions import vec as V
from lexigraph.operators import density as D
from lexigraph.operators import impute as I
from lexigraph.operators import learning as L
from lexigraph.operators import resampling as RS
from lexigraph.operators import sequences as seqs
from lexigraph.operators import sweep as SW
from lexigraph.shared import cut, new_path

from .base import draw, query, t
from .vectors import transitions, units


@query("m01_kmeans")
def m01(spark, d):
    return L.kmeans(units(spark, d), "u", 8)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("m01_cluster_continuity")
def m01b(spark, d):
    """Clusters in order within each group, run windows, and the counts as text (C0:5, C1:6)."""
    c = L.kmeans(units(spark, d), "u", 5)[0].select("label", "id", "cluster")
    runs = seqs.label_runs(c, "label", "id", "cluster").groupBy("label").agg(F.round(F.avg("window"), 6).alias("continuity"))
    n = c.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("label")
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "n"))), lambda s: F.concat(F.lit("C"), s["cluster"], F.lit(":"), s["n"])), ", ").alias("clusters"))
    return runs.join(text, "label")


@query("m02_k_sweep")
def m02(spark, d):
    return L.kmeans_sweep(units(spark, d), "u", [2, 4, 8])


@query("m03_lda_topics")
def m03(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source", T.tokens(F.col("text")).alias("tokens"))
    return L.lda_topics(x, "tokens", 5).select("source", "doc_id", "topic")


@query("m04_density_topics")
def m04(spark, d):
    """PCA to ten axes, then density clusters of all rows, in one numbering; -1 is noise."""
    p = L.pca(units(spark, d), "u", 10, "label", "id")
    return D.density_clusters(p.select("id", "label", "pc"), "pc", 5, 2, "id", "label", out="topic").select("label", "id", "topic")


@query("m07_pca_axis")
def m07(spark, d):
    return L.pca(units(spark, d), "u", 2, "id").select(F.col("id").alias("vec_id"), F.round(F.col("pc")[0], 6).alias("x"), F.round(F.col("pc")[1], 6).alias("y"))


def tabular(spark, d):
    k = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(7))
    return t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("y"), "l_returnflag",
        F.when(k != 0, F.col("l_quantity") * 2 + F.col("l_discount") * 10).alias("gap"),
    )


def _with_gaps(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return c.withColumn("target", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 2 + F.col("nation"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


@query("m09_imputation_contest")
def m09(spark, d):
    """Root mean squared errors of four methods on masked known values, where a feature has gaps too."""
    return I.contest(_with_gaps(spark, d), "target", ["c_acctbal", "nation"], "c_custkey")[0].select("method", F.round("rmse", 6).alias("rmse"), "best")


@query("m09_best_fill")
def m09b(spark, d):
    """All customers, the gaps of the target filled by the method that wins."""
    return I.contest(_with_gaps(spark, d), "target", ["c_acctbal", "nation"], "c_custkey")[1].select("c_custkey", F.round("target", 6).alias("target"))


@query("j18_knn_imputer", """with x as (select c_custkey, c_acctbal a, c_nationkey::double b, case when c_custkey % 5 <> 0 then c_acctbal / 2 end target from customer),
    s as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb from x where target is not null), z as (select c_custkey, target, (a - ma) / sa a, (b - mb) / sb b from x, s),
    p as (select t.c_custkey, d.target, row_number() over (partition by t.c_custkey order by round((t.a - d.a) * (t.a - d.a) + (t.b - d.b) * (t.b - d.b), 9), d.c_custkey) rn from z t, z d where t.target is null and d.target is not null)
    select c_custkey, round(avg(target), 6) imputed from p where rn <= 5 group by 1""")
def j18(spark, d):
    x = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 2).alias("target"))
    return L.knn_impute(x.where("target is not null"), x.where("target is null"), "target", ["c_acctbal", "nation"], "c_custkey").select("c_custkey", F.round("imputed", 6).alias("imputed"))


@query("m10_preprocessing")
def m10(spark, d):
    from pyspark.ml.functions import vector_to_array

    x = tabular(spark, d)
    m = L.preprocessor(["gap", "q"], ["l_returnflag"]).fit(x)
    return m.transform(x).select("id", vector_to_array("features").alias("features"))


@query("m11_grid_search")
def m11(spark, d):
    return L.grid_search(t(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 50).cast("double").alias("k"), F.col("p_retailprice").alias("y")), "y", ["size", "k"])


@query("m12_random_search")
def m12(spark, d):
    """Ridge strengths drawn from a hash, scored by held-out error; halves of the field are dropped on growing samples."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["q", "disc", "tax"], outputCol="x").transform(tabular(spark, d)).select("id", "x", "y").cache()
    field, rows, cells = [10 ** ((i * 7919 % 60) / 10 - 3) for i in range(1, 9)], [], 16
    while len(field) > 1:
        train, test = x.where(F.pmod(F.xxhash64("id"), F.lit(16)) < cells // 2), x.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0)
        scored = sorted((LinearRegression(featuresCol="x", labelCol="y", regParam=r).fit(train).evaluate(test).meanAbsoluteError, r) for r in field)
        rows += [(len(field), float(r), float(e)) for e, r in scored]
        field = [r for _, r in scored[: len(field) // 2]]
    return spark.createDataFrame(rows, "survivors int, reg double, mae double")


@query("m12_bayesian_sweep")
def m12b(spark, d):
    """A forest's settings by a surrogate and Hyperband brackets; a run's budget is its share of the rows, its score the weighted absolute percentage error of held-out rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x = VectorAssembler(inputCols=["q", "disc", "tax"], outputCol="x").transform(tabular(spark, d)).select("x", "y", draw(F.col("id")).alias("h"))
    x = cut(x.withColumn("test", F.col("h") % 5 == 0).withColumn("share", F.floor(F.col("h") / 5) % 1000), "sweep")

    def score(s, budget):
        model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["leaf"], featureSubsetStrategy=s["features"], seed=42)
        p = model.fit(x.where(~F.col("test") & (F.col("share") < 1000 * budget))).transform(x.where("test"))
        return p.agg(F.try_divide(F.sum(F.abs(F.col("y") - F.col("prediction"))), F.sum(F.abs("y")))).first()[0] or 0.0

    space = {"trees": SW.Range(2, 12, whole=True), "depth": SW.Range(2, 6, whole=True), "leaf": SW.Range(1, 10, whole=True), "features": ["sqrt", "log2"]}
    runs = SW.sweep(space, score, least=1 / 3)
    rows = [(i, r["bracket"], r["round"], r["budget"], *(r["setting"][c] for c in space), r["score"], r["kept"]) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, bracket int, round int, budget double, trees int, depth int, leaf int, features string, wmape double, kept boolean")


@query("m13_polynomial_ridge")
def m13(spark, d):
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["q"], outputCol="v").transform(tabular(spark, d)).cache()
    rows = []
    for k in (1, 2, 3):
        p = PolynomialExpansion(degree=k, inputCol="v", outputCol="x").transform(x)
        rows.append((k, float(LinearRegression(featuresCol="x", labelCol="y", regParam=0.1).fit(p).summary.r2)))
    return spark.createDataFrame(rows, "degree int, r2 double").withColumn("r2", F.round("r2", 6))


@query("m14_feature_importance")
def m14(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = ["q", "disc", "tax"]
    m = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=10, maxDepth=4, seed=42).fit(VectorAssembler(inputCols=names, outputCol="x").transform(tabular(spark, d)))
    rows = sorted(zip(names, map(float, m.featureImportances.toArray()), strict=True), key=lambda r: -r[1])[:10]
    return spark.createDataFrame(rows, "feature string, importance double")


@query("m15_annotation_join", "select doc_id, lang, coalesce(quality, -1) quality from documents left join labels using (doc_id)")
def m15(spark, d):
    """An external judge is a join to the table of its answers; rows without one get -1."""
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("m17_classification_report")
def m17(spark, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = t(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), array_to_vector(V.doubles(F.col("embedding"))).alias("x"), (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("test")).cache()
    p = LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.1).fit(x.where("not test")).transform(x.where("test"))
    both = p.select(F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
    seen = both.groupBy("label").agg(F.count(F.lit(1)).alias("support"), F.sum((F.col("label") == F.col("predicted")).cast("long")).alias("hit"))
    said = both.groupBy(F.col("predicted").alias("label")).agg(F.count(F.lit(1)).alias("said"))
    r = seen.join(said, "label", "left").na.fill(0)
    return r.select("label", "support", F.round(F.try_divide("hit", "support"), 6).alias("recall"), F.round(F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), 6).alias("precision"))


@query("m18_saved_clusterer")
def m18(spark, d):
    """Clusters from a model that was saved and loaded again, as at serving time."""
    from pyspark.ml.clustering import KMeans, KMeansModel
    from pyspark.ml.functions import array_to_vector

    x = units(spark, d).withColumn("x", array_to_vector("u"))
    path = new_path(spark, "kmeans")
    KMeans(k=10, seed=42, featuresCol="x").fit(x).write().overwrite().save(path)
    return KMeansModel.load(path).transform(x).select(F.col("id").alias("vec_id"), F.col("prediction").alias("cluster"))


@query("m19_fixed_domain_one_hot", "select o_orderkey, (o_orderstatus = 'F')::int f, (o_orderstatus = 'O')::int o, (o_orderstatus = 'P')::int p from orders")
def m19(spark, d):
    """The domain is fixed, so rows at serving time have the same columns whatever values occur."""
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", *((s == x).cast("int").alias(x.lower()) for x in ("F", "O", "P")))


@query("i17_logit")
def i17(spark, d):
    """Breaks by switch alone (M1), and with the place, its square and the kinds of both rows as dummies (M2)."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    e = transitions(spark, d).select((F.col("sim") < 0.0).cast("double").alias("broken"), (F.col("kind") != F.col("kind2")).cast("double").alias("sw"), ((F.col("pos") - 0.5) / (F.col("n") - 1)).alias("rel"), F.col("kind").cast("string").alias("kind"), F.col("kind2").cast("string").alias("kind2"))
    e, out = e.withColumn("rel2", F.col("rel") ** 2).na.drop(), []
    for name, right in (("M1", "sw"), ("M2", "sw + rel + rel2 + kind + kind2")):
        x = RFormula(formula=f"broken ~ {right}").fit(e).transform(e)
        attributes = x.schema["features"].metadata["ml_attr"]["attrs"]
        terms = [a["name"] for a in sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])]
        m = GeneralizedLinearRegression(family="binomial", maxIter=25).fit(x)
        out += list(zip([name] * (len(terms) + 1), [*terms, "1"], [*map(float, m.coefficients), float(m.intercept)], map(float, m.summary.coefficientStandardErrors), map(float, m.summary.pValues), strict=True))
    return spark.createDataFrame(out, "model string, term string, beta double, se double, p double")


@query("i20_odds_ratios")
def i20(spark, d):
    c = i17(spark, d)
    e = F.exp("beta")
    return c.select("model", "term", F.round(e, 6).alias("odds"), F.round(F.exp(F.col("beta") - 1.959964 * F.col("se")), 6).alias("lo"), F.round(F.exp(F.col("beta") + 1.959964 * F.col("se")), 6).alias("hi"))


def _clustered(spark, d):
    return transitions(spark, d).select(F.col("g").alias("grp"), (F.col("sim") < 0.0).cast("double").alias("y"), (F.col("kind") != F.col("kind2")).cast("double").alias("sw"), ((F.col("pos") - 0.5) / (F.col("n") - 1)).alias("rel"))


@query("i18_gee")
def i18(spark, d):
    r = L.gee_exchangeable(_clustered(spark, d), "y", ["sw", "rel"], "grp")
    return spark.createDataFrame([(n, float(b), float(s), S.normal_tail(b / s), r["rho"]) for n, b, s in zip(r["names"], r["beta"], r["se"], strict=True)], "term string, beta double, se double, p double, rho double")


@query("i19_mixed_model")
def i19(spark, d):
    r = L.mixed_model(_clustered(spark, d), "y", ["sw", "rel"], "grp")
    return spark.createDataFrame([(n, float(b), float(s), S.normal_tail(b / s), r["sigma2"], r["tau2"]) for n, b, s in zip(r["names"], r["beta"], r["se"], strict=True)], "term string, beta double, se double, p double, sigma2 double, tau2 double")


@query("i16_ols_controls")
def i16c(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = ["q", "disc", "tax"]
    m = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=names, outputCol="x").transform(tabular(spark, d)))
    s = m.summary
    return spark.createDataFrame([(n, float(b), float(e), float(p), float(s.r2)) for n, b, e, p in zip([*names, "1"], [*m.coefficients, m.intercept], s.coefficientStandardErrors, s.pValues, strict=True)], "term string, beta double, se double, p double, r2 double")


@query("i27_bias_variance")
def i27(spark, d):
    """Squared bias, variance and squared error of polynomials of degree 1 to 15 over 100 bootstrap replicates of seven tenths of the parts, against the others."""
    y = F.sin(F.col("p_size") / 8.0) + F.pmod(F.xxhash64("p_partkey"), F.lit(100)) / 200.0
    x = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), y.alias("y"), (draw(F.col("p_partkey")) % 10 < 3).alias("test"))
    rows = RS.bias_variance(x.where("not test"), x.where("test"), list(range(1, 16)), 100, alpha=1e-3)
    out = spark.createDataFrame(rows, "degree int, bias2 double, variance double, mse double")
    return out.select("degree", *(F.round(c, 6).alias(c) for c in ("bias2", "variance", "mse")))


@query("i28_learning_curve", " union all ".join(f"select {k / 8}::double fraction, round(sqrt(avg((y - (s * q + i)) ** 2)), 4) rmse from (select l_quantity q, l_extendedprice y from lineitem where l_orderkey % 8 = 7), (select regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i from lineitem where l_orderkey % 8 < {k})" for k in (1, 2, 4, 7)))
def i28(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_orderkey") % 8).alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y"))
    out = None
    for k in (1, 2, 4, 7):
        fit = x.where(F.col("k") < k).agg(F.regr_slope("y", "q").alias("s"), F.regr_intercept("y", "q").alias("i"))
        one = x.where("k = 7").crossJoin(F.broadcast(fit)).agg(F.round(F.sqrt(F.avg((F.col("y") - (F.col("s") * F.col("q") + F.col("i"))) ** 2)), 4).alias("rmse")).select(F.lit(k / 8).alias("fraction"), "rmse")
        out = one if out is None else out.union(one)
    return out


@query("i29_split_dispersion")
def i29(spark, d):
    """Spread of the share of English in test parts of 50 random and 50 stratified splits."""
    r = t(spark, d, "documents").select("doc_id", "lang").crossJoin(F.broadcast(spark.range(50).select(F.col("id").alias("rep"))))
    h = F.xxhash64("doc_id", "rep")
    rand = r.withColumn("test", F.pmod(h, F.lit(5)) == 0).withColumn("kind", F.lit("random"))
    rn, n = F.row_number().over(W.partitionBy("rep", "lang").orderBy(h, "doc_id")), F.count(F.lit(1)).over(W.partitionBy("rep", "lang"))
    strat = r.withColumn("test", rn <= F.round(n * 0.2)).withColumn("kind", F.lit("stratified"))
    share = rand.unionByName(strat).where("test").groupBy("kind", "rep").agg(F.avg((F.col("lang") == "en").cast("double")).alias("x"))
    return share.groupBy("kind").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("i30_treatment_effect")
def i30(spark, d):
    """Naive and doubly robust average treatment effect."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    x = tabular(spark, d).select("id", "q", "disc", (F.col("disc") > 0.05).cast("double").alias("w"), "y", "tax")
    v = VectorAssembler(inputCols=["q", "tax"], outputCol="x").transform(x)
    ps = LogisticRegression(featuresCol="x", labelCol="w", probabilityCol="pr", predictionCol="pp", rawPredictionCol="rp").fit(v).transform(v)
    fit = lambda k: LinearRegression(featuresCol="x", labelCol="y", predictionCol=f"m{k}").fit(v.where(F.col("w") == k))
    z = fit(0).transform(fit(1).transform(ps)).withColumn("e", F.greatest(F.lit(0.01), F.least(F.lit(0.99), vector_to_array("pr")[1])))
    dr = F.col("m1") - F.col("m0") + F.col("w") * (F.col("y") - F.col("m1")) / F.col("e") - (1 - F.col("w")) * (F.col("y") - F.col("m0")) / (1 - F.col("e"))
    w = F.col("w") == 1
    return z.agg(F.round(F.avg(F.when(w, F.col("y"))) - F.avg(F.when(~w, F.col("y"))), 4).alias("naive"), F.round(F.avg(dr), 4).alias("doubly_robust"))
