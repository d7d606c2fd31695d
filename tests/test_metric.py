"""The metric index: equal to all pairs, whatever it skips; and it skips most block pairs of clustered rows."""

import numpy as np
import pytest

from lexigraph.operators import geometry, metric


def vectors(kind, n, d=12, seed=2):
    r = np.random.default_rng(seed)
    near = r.normal(size=(max(1, n // 60), d))
    x = {"clustered": near[r.integers(0, len(near), n)] + 0.1 * r.normal(size=(n, d)), "flat": r.normal(size=(n, d)), "copies": np.ones((n, d)) + (r.random((n, 1)) < 0.3)}[kind]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), f"g{i % 5}") for i, v in enumerate(x)], "id long, u array<double>, label string")


def best(s, k):
    return np.argsort(np.round(-s, 9), axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("kind", ["clustered", "flat", "copies"])
def test_neighbours(spark, kind):
    x = vectors(kind, 700)
    df = frame(spark, x)
    s = x @ x.T
    for far in (False, True):
        own = -s if far else s.copy()
        np.fill_diagonal(own, -9)
        got = sorted((r["i"], r["rank"], r["j"]) for r in metric.nearest(df, None, 4, far=far, rows=16).collect())
        want = sorted((i, k + 1, int(j)) for i, row in enumerate(best(own, 4)) for k, j in enumerate(row))
        sims = {(i, k): round(float(own[i, j]), 9) for i, k, j in want}
        assert [(i, k) for i, k, _ in got] == [(i, k) for i, k, _ in want]
        assert all(abs(round(float(own[i, j]), 9) - sims[i, k]) < 3e-9 for i, k, j in got)
        if kind != "copies":  # rounding may order copies of one vector by their last digit
            assert got == want


def test_neighbours_of_another_table(spark):
    x, y = vectors("clustered", 90, seed=3) * 40 + 1000, vectors("clustered", 500, seed=4) * 40 + 1000
    a, b = frame(spark, x), frame(spark, y).withColumn("id", geometry.F.col("id") + 10_000)
    d = ((x[:, None] - y[None]) ** 2).sum(-1)
    stats = {}
    got = {(r["i"], r["rank"]): (r["j"], r["label_j"]) for r in metric.nearest(a, b, 3, metric.EUCLID, rows=8, stats=stats).collect()}
    assert {k: j for k, (j, _) in got.items()} == {(i, k + 1): int(j) + 10_000 for i, row in enumerate(best(-d, 3)) for k, j in enumerate(row)}
    assert all(label == f"g{(j - 10_000) % 5}" for j, label in got.values()) and stats["done"] < stats["pairs"]


def test_odd_vectors_meet_all_others(spark):
    x = vectors("clustered", 300)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(300, [0.0] * 12, "b"), (301, [0.0] * 12, "b"), (302, [0.6, 0.8], "b"), (303, [1.0], "b"), (304, [], "b")]
    df = spark.createDataFrame(rows, "id long, u array<double>, label string")
    got = {}
    for r in metric.nearest(df, None, 3, rows=8).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["sim"]))
    assert len(got) == 305 and all(len(v) == 3 for v in got.values())
    assert sorted(got[300]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert [j for _, j, _ in sorted(got[302])] == [0, 1, 2] and all(s is None for *_, s in got[302])
    assert metric.nearest(df.where("false"), None, 3).count() == 0 and metric.top_pairs(df.where("false"), 3).count() == 0 and metric.best_between(df.where("false"), "label").count() == 0


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_pairs(spark, kind):
    x = vectors(kind, 400)
    df = frame(spark, x)
    s = x @ x.T
    apart = (np.arange(400)[:, None] - np.arange(400)) % 5 != 0
    i, j = np.nonzero((s > 0.5) & (np.arange(400)[:, None] < np.arange(400)))
    assert {(r["i"], r["j"]) for r in metric.all_pairs(df, 0.5, rows=16).collect()} == set(zip(i.tolist(), j.tolist(), strict=True))
    i, j = np.nonzero(apart & (np.arange(400)[:, None] < np.arange(400)))
    order = sorted(zip(np.round(-s[i, j], 9), i.tolist(), j.tolist(), strict=True))
    assert [(r["i"], r["j"]) for r in metric.top_pairs(df, 7, "label", rows=16).collect()] == [(a, b) for _, a, b in order[:7]]
    want = {}
    for m, a, b in sorted((m, *((a, b) if a % 5 < b % 5 else (b, a))) for m, a, b in order):
        want.setdefault((f"g{a % 5}", f"g{b % 5}"), (a, b))
    assert {(r["g"], r["h"]): (r["i"], r["j"]) for r in metric.best_between(df, "label", rows=16).collect()} == want
    total = geometry.pair_sums(df).first()
    assert total["n"] == 400 * 399 // 2 and abs(total["total"] - s[np.triu_indices(400, 1)].sum()) < 1e-6


def test_work_grows_with_what_is_near(spark):
    done = []
    for n in (1000, 4000):
        stats = {}
        metric.nearest(frame(spark, vectors("clustered", n)), None, 3, rows=16, stats=stats).count()
        assert stats["done"] < 0.5 * stats["pairs"]
        done.append(stats["done"])
    assert done[1] < 8 * done[0]  # all pairs would be 16 times as many
