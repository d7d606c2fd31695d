"""Small brute-force and algebraic checks of operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.functions import stats as S
from lexigraph.functions import vec as V
from lexigraph.operators import graph as G
from lexigraph.operators import learning as L
from lexigraph.operators import sequences as Q
from lexigraph.operators.components import connected_components


def table(spark, n=40, groups=3, dim=8, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(int(i), int(i % groups), r.normal(size=dim).tolist()) for i in range(n)], "id long, g int, v array<double>")


def test_zero_and_infinite_vectors_become_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), ([float("inf"), 1.0],), ([float("nan"), 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.unit(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]


@pytest.mark.parametrize("inclusive", [True, False])
def test_attention_windows_match_loops(spark, inclusive):
    df = table(spark)
    e = Q.numbered(df, "g", "id", "v")
    got = {(r["theta"], r["id"]): r["window"] for r in Q.attention_windows(e, [-0.3, 0.1], inclusive).collect()}
    rows = df.collect()
    for theta in (-0.3, 0.1):
        for g in range(3):
            x = [(r["id"], np.array(r["v"]) / np.linalg.norm(r["v"])) for r in rows if r["g"] == g]
            last = None
            for k, (i, u) in enumerate(x):
                w = 0
                for _, v in x[k + 1 :]:
                    if not (u @ v >= theta if inclusive else u @ v > theta):
                        break
                    w += 1
                assert got[theta, i] == w
    assert all(got[-0.3, r["id"]] >= got[0.1, r["id"]] for r in rows)


def test_label_runs(spark):
    labels = "aabbbac"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(labels)], "g int, i int, c string")
    got = [r["window"] for r in Q.label_runs(df, "g", "i", "c").orderBy("i").collect()]
    assert got == [1, 0, 2, 1, 0, 0, 0]


def test_components_against_search(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 1)], "src long, dst long")
    got = {x["node"]: x["component"] for x in connected_components(df).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = [s]
            while todo:
                u = todo.pop()
                if u not in want:
                    want[u] = s
                    todo += near[u]
    assert got == want
    assert connected_components(df.where("false")).count() == 0


def graph(spark, edges, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double")


def test_modularity_of_one_block_is_zero_and_cliques_are_found(spark):
    edges = [(a, b, 1.0) for c in (0, 5) for a, b in itertools.combinations(range(c, c + 5), 2)] + [(4, 5, 1.0)]
    nodes, e = graph(spark, edges, 10)
    one = nodes.withColumn("label", F.lit(1))
    assert abs(G.modularity(e, one).first()[0]) < 1e-12
    labels = {r["id"]: r["label"] for r in G.louvain(nodes, e).collect()}
    assert len(set(labels.values())) == 2 and len({labels[i] for i in range(5)}) == 1
    assert G.modularity(e, G.louvain(nodes, e)).first()[0] > 0.4
    assert {r["id"]: r["n"] for r in G.triangles(e).collect()} == {i: 6 for i in range(10)}


def test_betweenness_of_a_path_and_hops(spark):
    nodes, e = graph(spark, [(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5)], 5)
    b = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, e).collect()}
    # ordered pairs through 1 and 2: (0,2), (0,3) and back; 4 of (5 - 1)(5 - 2)
    assert b == {0: 0.0, 1: 4 / 12, 2: 4 / 12, 3: 0.0, 4: 0.0}
    p = {r["id"]: (r["reached"], r["total"]) for r in G.path_lengths(nodes, e).collect()}
    assert p[0] == (3, 6) and p[4] == (0, 0)


def test_tail_probabilities():
    assert abs(S.normal_tail(1.959964) - 0.05) < 1e-6
    assert abs(S.t_tail(2.228139, 10) - 0.05) < 1e-6
    assert abs(S.chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(S.chi2_tail(100.0, 100) - 0.481191) < 1e-4


def test_mixed_model_recovers_effects(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(60):
        u = r.normal(0, 1.0)
        for _ in range(20):
            x = r.normal()
            rows.append((g, float(x), float(1 + 2 * x + u + r.normal(0, 0.5))))
    m = L.mixed_model(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g")
    assert abs(m["beta"][1] - 2) < 0.05 and abs(m["sigma2"] - 0.25) < 0.05 and 0.5 < m["tau2"] < 1.8


def test_pca_is_centred_and_ordered(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 4)) * [5, 2, 1, 0.1] + 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    pc = np.array([p["pc"] for p in L.pca(df, "v", 2, "id").orderBy("id").collect()])
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(pc), np.abs((want[0] * want[1])[:, :2]), atol=1e-8)
    assert math.isclose(pc.mean(), 0, abs_tol=1e-9)


def test_nearest_searches_every_block(spark):
    """Several blocks, ties, repeated ids, missing ids, coordinates and vectors of another length, against all pairs."""
    import numpy as np

    from lexigraph.operators import geometry as geo
    from lexigraph.operators import metric

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(0, 3, 2)]) for i in range(120)] + [(5, [1.0, None]), (None, [0.0, 0.0]), (700, [2.0])]
    a = spark.createDataFrame(rows[:30] + rows[-3:], "id long, u array<double>")
    b = spark.createDataFrame(rows, "id long, u array<double>")
    got = sorted((r["i"], r["rank"], r["j"]) for r in geo.nearest(a.where("id <> 700 and id <> 5"), b.where("id <> 700"), 4, metric.EUCLID).collect())
    want = []
    for i, u in rows[:30]:
        if i == 5:
            continue
        far = lambda v: sum((x - y) ** 2 for x, y in zip(u, v) if y is not None) * 2 / sum(y is not None for y in v)  # noqa: B023, E731
        best = sorted((round(far(v), 9), j) for j, v in rows if j not in (None, i, 700))[:4]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(best)]
    assert got == sorted(want)
    sims = {r["j"]: r["sim"] for r in geo.all_pairs(b.where("id in (0, 1, 700)")).collect()}
    assert sims[700] is None and sims[1] is not None
    assert geo.nearest(a.where("false"), b, 4).count() == 0 and geo.nearest(a, b.where("false"), 4).count() == 0


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from lexigraph.operators.order import places, running

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("more"))
    assert sorted((r["k"], r["place"]) for r in places(df, "k").collect()) == [(k, k + 1) for k in range(1000)]
    assert sorted((r["k"], r["s"]) for r in running(df, ["k"], s=F.col("k") * 2).collect()) == [(k, k * (k + 1)) for k in range(1000)]
    assert places(df.where("false"), "k").count() == 0
    assert sorted(r["place"] for r in places(spark.createDataFrame([(None,), (None,), (1,)], "k int"), "k").collect()) == [1, 2, 3]


def test_rolling_coherence_by_definition(spark):
    import numpy as np

    from lexigraph.operators import sequences as S

    rng = np.random.default_rng(4)
    rows = [(g, p, [float(v) for v in rng.normal(size=3)]) for g, n in (("a", 9), ("b", 5), ("c", 4), ("d", 1)) for p in range(n)]
    got = {(r["g"], r["start"]): r["coherence"] for r in S.rolling_coherence(S.numbered(spark.createDataFrame(rows, "g string, p long, v array<double>"), "g", "p", "v")).collect()}
    want = {}
    for g in "abcd":
        v = np.array([x[2] for x in rows if x[0] == g])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for s in range(len(v) - 4):
            m = v[s : s + 5] @ v[s : s + 5].T
            want[g, s + 1] = m[np.triu_indices(5, 1)].mean()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
