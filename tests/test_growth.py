"""Work and shipped rows grow with the input: tiles, medians, moments and shuffled orders against plain arithmetic."""

import numpy as np
import pytest

from lexigraph import queries as core
from lexigraph.operators import density, geometry, graph, metric

from tests.test_metric import frame, vectors

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def saved(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_tiles_along_a_side_are_few(spark):
    x = vectors("flat", 3000)
    index = metric.Index(frame(spark, x), rows=4)
    assert index.n_blocks >= 750 and index.n_blocks >> index.tile <= metric.SIDES
    assert sorted(r["block"] for r in index.blocks.select("block").collect()) == list(range(index.n_blocks))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i, k + 1, int(j)) for i, row in enumerate(np.argsort(np.round(-s, 9), axis=1, kind="stable")[:, :3]) for k, j in enumerate(row)}
    assert {(r["i"], r["rank"], r["j"]) for r in metric.nearest(frame(spark, x), None, 3, rows=4).collect()} == want


def test_blocks_are_shipped_as_often_at_any_size(spark):
    def counted(ts):
        return metric.pa.table({"n": [len(metric.pa.concat_tables(ts)["n"].unique())]})

    copies = []
    for n in (300, 3000):
        index = metric.Index(frame(spark, vectors("flat", n)), rows=4)
        met = index.run(index.close(-np.inf, ordered=True), lambda one, others: metric.pa.table({"n": [one["block"], *(o["block"] for o in others)]}), "n long", fold=counted)
        copies.append(sum(r["n"] for r in met.collect()) / index.n_blocks)
        assert -(-index.n_blocks // index.tile) <= metric.SIDES
    assert copies[1] <= 1.1 * copies[0] and max(copies) <= metric.SIDES


def test_best_between_keeps_no_pairs_but_the_best(spark):
    x = vectors("copies", 200)
    got = {(r["g"], r["h"]): (r["i"], r["j"]) for r in metric.best_between(frame(spark, x), "label", rows=16).collect()}
    one = [i for i in range(200) if x[i] @ x[0] > 1 - 1e-9]
    assert len(got) == 10 and all(abs(x[i] @ x[j] - 1) < 1e-9 for i, j in got.values()) and one
    work = metric.pair_work([], metric.cosine, None, None, lambda t: t.slice(0, 1), 1, 2.0)
    block = {"block": 0, "id": metric.pa.array([0, 1]), "x": (x[:2], np.array([12, 12]))}
    assert len(work(block, [block])) == 0  # nothing reaches the floor


@pytest.mark.parametrize("kind", ["flat", "copies", "clustered"])
def test_median_of_all_pairs(spark, kind):
    x = vectors(kind, 301)
    want = np.median((x @ x.T)[np.triu_indices(301, 1)])
    for most in (1 << 20, 50):
        assert abs(metric.middle(frame(spark, x).select("id", "u"), bins=64, most=most) - want) < 1e-11
    assert metric.middle(frame(spark, x[:1]).select("id", "u")) is None


def test_moments_of_pairs(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 64)).astype("f4")
    ids = [*range(55), 3, 3, 7, 8, 9]
    d = saved(spark, tmp_path, [(k, v.tolist(), i % 3) for i, (k, v) in enumerate(zip(ids, x, strict=True))] + [(99, [1.0, 2.0], 0), (100, None, 1), (101, [1.0], 7), (102, [2.0], 7)])
    x = x.astype(float)
    halves = [h / np.linalg.norm(h, axis=1, keepdims=True) for h in (x[:, :32], x[:, 32:])]
    i, j = np.nonzero(np.array(ids)[:, None] < np.array(ids))
    s, z = ((h @ h.T)[i, j] for h in halves)
    got = core.queries()["i14_geometry_agreement"](spark, d).first()
    n = 63 * 62 // 2 - 3 - 3  # pairs of rows, less those of one id
    assert abs(got["r"] - np.corrcoef(np.r_[s, 1], np.r_[z, 0])[0, 1]) < 1e-5 and got["n"] == n
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a23 = core.queries()["a23_global_coherence"](spark, d)
    sims = {k: (u[k::3] @ u[k::3].T)[np.triu_indices(20, 1)] for k in range(3)}
    assert all(np.allclose((r["mean"], r["std"]), (sims[r["label"]].mean(), sims[r["label"]].std()), atol=1e-5) for r in a23.collect()) and a23.count() == 3
    assert "pos" not in plan(a23)  # rows meet no rows
    f34 = core.queries()["f34_theta_all_pairs"](spark, d).first()
    sims = (u @ u.T)[i, j]
    assert abs(f34["med"] - np.median(np.r_[sims, 1.0])) < 1e-5 and abs(f34["std"] - np.r_[sims, 1.0].std()) < 1e-5


def test_shuffled_orders_meet_only_next_rows(spark):
    p = plan(core.queries()["i08_permute_order"](spark, SF))
    assert "Join Inner" not in p.replace("Join Cross", "")


def test_median_error_is_not_held_in_one_task(spark):
    p = plan(core.queries()["f35_error_metrics"](spark, SF))
    assert "median(" not in p and "percentile" not in p


def test_sources_are_dealt_to_all_cores(spark):
    r = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 90, (160, 2)) if a < b}
    nodes = spark.createDataFrame([(i,) for i in range(95)], "id long").coalesce(1)
    edges = spark.createDataFrame([(a, b, 0.5) for a, b in sorted(pairs)], "src long, dst long, weight double").coalesce(1)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in range(95):
        dist, front = {s: 0}, [s]
        while front:
            front = [v for u in front for v in sorted(near.get(u, ())) if v not in dist and dist.setdefault(v, dist[u] + 1)]
        want[s] = (len(dist) - 1, sum(dist.values()))
    for batch in (1024, 70, 3):
        assert {r["id"]: (r["reached"], r["total"]) for r in graph.path_lengths(nodes, edges, batch=batch).collect()} == want
    assert graph.dealt(spark, 95).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # what lies between is, added up, each pair's hops less one
    total = sum(r["betweenness"] for r in graph.betweenness(nodes, edges).collect()) * 94 * 93
    assert abs(total - sum(t - n for n, t in want.values())) < 1e-6
    assert graph.path_lengths(nodes, edges.where("false")).agg({"total": "sum"}).first()[0] == 0


def test_least_edges_do_not_take_differences_of_all_pairs(monkeypatch):
    r = np.random.default_rng(3)
    x, comp, core = 1e6 + r.normal(size=(900, 6)), r.integers(0, 40, 900), r.random(900)
    part = lambda i: slice(30 * i, 30 * i + 30)
    blocks = [{"block": i, "x": (x[part(i)], np.full(30, 6)), **{k: metric.pa.array(v[part(i)]) for k, v in (("id", np.arange(900)), ("core", core), ("comp", comp))}} for i in range(30)]
    monkeypatch.setattr(metric, "nearness", None)
    got = {e["comp"]: (e["lo"], e["hi"], e["other"]) for e in density.least_edges(blocks[4], blocks).to_pylist()}
    w = np.maximum(np.sqrt(((x[part(4), None] - x) ** 2).sum(-1)), np.maximum(core[part(4), None], core))
    w[comp[part(4), None] == comp] = np.inf
    for c in set(comp[part(4)].tolist()):
        i, j = min(((i, j) for i in range(30) if comp[120 + i] == c for j in range(900)), key=lambda p: (w[p], min(p[0] + 120, p[1]), max(p[0] + 120, p[1])))
        assert got[c] == (min(i + 120, j), max(i + 120, j), comp[j])


def test_shortest_paths_are_taken_as_arrays(spark, monkeypatch):
    r = np.random.default_rng(11)
    heap = graph.searched

    def arrays(n, m, lengths):
        key = np.unique([(min(a, b), max(a, b)) for a, b in r.integers(0, n, (m, 2)) if a != b], axis=0)
        s, t = np.r_[key[:, 0], key[:, 1]], np.r_[key[:, 1], key[:, 0]]
        w = lengths(len(key))
        by = np.argsort(s, kind="stable")
        return np.searchsorted(s[by], np.arange(n + 1)), t[by].astype(np.int32), np.r_[w, w][by]

    # many ties, none, a hub past the columns, parts that are not joined, no edge
    for n, m, lengths in [(60, 150, lambda k: r.integers(1, 3, k) / 4), (200, 700, lambda k: r.random(k) + 0.01), (90, 3000, lambda k: r.integers(1, 9, k) / 8), (80, 40, lambda k: r.random(k) + 0.1), (3, 0, lambda k: r.random(k))]:
        ptr, near, far = arrays(n, m, lengths) if m else (np.zeros(n + 1, int), np.zeros(0, np.int32), np.zeros(0))
        links = [list(zip(near[a:b].tolist(), far[a:b].tolist(), strict=True)) for a, b in zip(ptr, ptr[1:], strict=False)]
        order, *rows = graph.by_degree(ptr, near, far)
        place = np.argsort(order)
        for s in range(0, n, 7):
            want = heap(links, s)
            with monkeypatch.context() as m_:
                m_.setattr(graph, "heapq", None)
                got = np.zeros(n)
                got[order] = graph.loads(*rows, place[s])
            assert np.allclose(got, want, atol=1e-9)
    # a path of more steps than rounds, and edges without length, go node by node
    for n, weight in ((330, 0.5), (9, 1.0)):
        nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
        edges = spark.createDataFrame([(i, i + 1, weight) for i in range(n - 1)], "src long, dst long, weight double")
        got = {x["id"]: x["betweenness"] * (n - 1) * (n - 2) for x in graph.betweenness(nodes, edges).collect()}
        assert all(abs(got[i] - 2 * i * (n - 1 - i)) < 1e-6 for i in range(n))


def test_a_tile_holds_one_result_of_its_blocks(spark):
    def one_by_one(ts):
        return metric.pa.table({"n": [int(hasattr(ts, "__len__")), *(len(t) for t in ts)]})

    index = metric.Index(frame(spark, vectors("flat", 300)), rows=16)
    met = index.run(index.close(-np.inf), lambda one, others: metric.pa.table({"n": [7]}), "n long", fold=one_by_one)
    assert {r["n"] for r in met.collect()} == {0, 1}


def test_cross_pairs_are_products_of_blocks(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (3, [0.0] * 6), (60, [1.0]), (61, [])]
    a = spark.createDataFrame(rows, "id long, u array<double>")
    got = geometry.cross(a, a, rows=7)
    assert "zip_with" not in plan(core.queries()["j14_cross_corpus"](spark, SF)) and got.count() == 54 * 54
    key = lambda p: (repr(p[0]), repr(p[1]), repr(p[2]))
    want = [(i, j, None if len(u) != len(v) else round(float(np.dot(u, v)), 6) + 0.0) for i, u in rows for j, v in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert geometry.cross(a.where("false"), a).count() == 0 == geometry.cross(a, a.where("false")).count()


def test_topic_terms_are_counted_once(spark):
    p = plan(core.queries()["m04_topic_terms"](spark, SF))
    assert "regexp_extract_all" not in p and "terms" in str(core.queries()["m04_topic_terms"](spark, SF).inputFiles())
