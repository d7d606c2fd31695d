"""Bootstrap fits from moments against least squares over resampled rows; chained imputation and its contest; sweeps against written-out traces."""

import math

import numpy as np
import pytest

from lexigraph.operators import impute, resampling, sweep


def test_copies_are_poisson_and_fixed():
    c = resampling.copies(np.arange(20_000), 20)
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02 and abs((c == 0).mean() - math.exp(-1)) < 0.005
    assert (c == resampling.copies(np.arange(20_000), 20)).all() and abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.03


def test_bias_variance_against_least_squares(spark):
    r = np.random.default_rng(3)
    x, noise = r.uniform(2, 5, 400), r.normal(0, 0.1, 400)
    y = np.sin(3 * x) + noise
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, 1.0, None)], "id long, x double, y double").repartition(3)
    got = resampling.bias_variance(df.where("id < 280 or id >= 900"), df.where("id >= 280"), [1, 4, 9, 15], 30, alpha=1e-6)
    lo, hi, w = x[:280].min(), x[:280].max(), resampling.copies(np.arange(280), 30)
    for (d, bias, variance, mse) in got:
        t, u = (np.polynomial.chebyshev.chebvander((2 * v - lo - hi) / (hi - lo), d) for v in (x[:280], x[280:]))
        p = []
        for b in range(30):
            k = np.repeat(np.arange(280), w[:, b].astype(int))
            ridge = 1e-6 * len(k) * np.diag([0.0] + [1.0] * d)
            p.append(u @ np.linalg.solve(t[k].T @ t[k] + ridge, t[k].T @ y[k]))
        p = np.array(p)
        assert np.allclose([bias, variance, mse], [((p.mean(0) - y[280:]) ** 2).mean(), p.var(0).mean(), ((p - y[280:]) ** 2).mean()], rtol=1e-6)
        assert math.isclose(mse, bias + variance, rel_tol=1e-9)
    assert resampling.bias_variance(df.where("false"), df, [1], 5) == []


def test_chained_equations_fill_and_settle(spark):
    r = np.random.default_rng(5)
    a = r.uniform(0, 10, 400)
    rows = [(i, float(v) if i % 9 else None, float(2 * v) if i % 7 else None, None, f"t{i}") for i, v in enumerate(a)]
    out, moves = impute.chained(spark.createDataFrame(rows, "id long, a double, b double, none double, text string"), ["a", "b", "none"], "id", trees=8, depth=6)
    got = {x["id"]: x for x in out.collect()}
    assert out.columns == ["id", "a", "b", "none", "text"] and len(got) == 400 and moves[-1] < moves[0]
    for i, v in enumerate(a):
        x = got[i]
        assert x["none"] is None and x["text"] == f"t{i}"
        assert (x["a"] == v if i % 9 else x["a"] is not None) and (x["b"] == 2 * v if i % 7 else x["b"] is not None)
        if i % 9 == 0 and i % 7:
            assert abs(x["a"] - v) < 1.2
    assert impute.chained(spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, b double"), ["a", "b"], "id")[1] == []


@pytest.mark.parametrize("winner", ["chained", "median"])
def test_the_contest_fills_with_its_winner(spark, winner):
    r = np.random.default_rng(6)
    rows = []
    for i in range(500):
        x, z = r.uniform(0, 10), r.uniform(0, 10)
        # steps of two features that neighbours blur; or a constant with rare far values that features don't tell
        y = 100.0 * (x > 5) + 40.0 * (z > 5) if winner == "chained" else (5.0 if i % 50 else 9.0)
        rows.append((i, y if i % 6 else None, x, z))
    df = spark.createDataFrame(rows, "id long, y double, x double, z double")
    scores, filled = impute.contest(df, "y", ["x", "z"], "id", trees=10, depth=4)
    table = {s["method"]: s["rmse"] for s in scores.collect()}
    best = [s["method"] for s in scores.where("best").collect()]
    assert set(table) == {"mean", "median", "knn", "chained"} and best == [min(sorted(table), key=table.get)]
    got = {x["id"]: x["y"] for x in filled.collect()}
    assert all(v is not None for v in got.values()) and all(got[i] == y for i, y, *_ in rows if y is not None) and filled.columns == df.columns
    if winner == "chained":
        assert best == ["chained"] and all(abs(got[i] - (100.0 * (x > 5) + 40.0 * (z > 5))) < 30 for i, _, x, z in rows if abs(x - 5) > 0.5 and abs(z - 5) > 0.5)


def test_places_and_values_agree():
    spaces = [sweep.Range(1, 9), sweep.Range(2, 7, whole=True), sweep.Range(1e-3, 10, log=True), ["a", "b", "c"]]
    for s in spaces:
        for u in (0.0, 0.2, 0.5, 0.99):
            v = sweep.value(s, u)
            assert sweep.value(s, sweep.place(s, v)) == pytest.approx(v) if not isinstance(v, str) else sweep.value(s, sweep.place(s, v)) == v
    assert {sweep.value(spaces[1], u) for u in np.linspace(0, 1, 50)} == set(range(2, 8))


def test_surrogate_and_improvement_by_their_formulas():
    r = np.random.default_rng(1)
    x, q = r.random((7, 2)), r.random((5, 2))
    y = np.sin(5 * x[:, 0]) + x[:, 1]
    m = sweep.Surrogate(x, y)
    k = sweep.kernel(x, x, m.scale) + 1e-6 * np.eye(7)
    ks = sweep.kernel(q, x, m.scale)
    mean, deviation = m.at(q)
    z = (y - y.mean()) / y.std()
    assert np.allclose(mean, y.mean() + y.std() * ks @ np.linalg.inv(k) @ z, atol=1e-6)
    assert np.allclose(deviation**2, y.std() ** 2 * (1 - np.einsum("ij,jk,ik->i", ks, np.linalg.inv(k), ks)), atol=1e-6)
    draws = r.normal(0.3, 0.5, 2_000_000)
    assert abs(sweep.expected_improvement(np.array([0.3]), np.array([0.5]), 0.1)[0] - np.maximum(0.1 - draws, 0).mean()) < 2e-3


def test_brackets_by_hand():
    assert sweep.brackets(1.0, 1 / 9) == [[(9, 1 / 9), (3, 1 / 3), (1, 1.0)], [(5, 1 / 3), (1, 1.0)], [(3, 1.0)]]
    assert sweep.brackets(1.0, 1.0) == [[(1, 1.0)]]


def test_sweep_replays_a_written_trace():
    space = {"x": sweep.Range(0, 1), "k": ["a", "b"]}
    score = lambda s, budget: (s["x"] - 0.3) ** 2 + (s["k"] == "b") * 0.1 + 0.01 / budget
    runs = sweep.sweep(space, score)
    assert [(r["bracket"], r["round"]) for r in runs] == [(0, 0)] * 9 + [(0, 1)] * 3 + [(0, 2)] + [(1, 0)] * 5 + [(1, 1)] + [(2, 0)] * 3
    # the first four are the spread sequence: halves, quarters; thirds
    assert [(r["setting"]["x"], r["setting"]["k"]) for r in runs[:4]] == [(0.5, "a"), (0.25, "b"), (0.75, "a"), (0.125, "a")]
    first = sorted(range(9), key=lambda i: runs[i]["score"])[:3]
    assert [r["kept"] for r in runs[:9]] == [i in first for i in range(9)] and [r["setting"] for r in runs[9:12]] == [runs[i]["setting"] for i in sorted(first)]
    for at in range(4, 9):  # a proposal follows from the scores before it alone
        assert runs[at]["setting"] == sweep.propose(space, [(r["setting"], r["score"]) for r in runs[:at]])
    best = min(runs, key=lambda r: r["score"])
    assert abs(best["setting"]["x"] - 0.3) < 0.02 and best["setting"]["k"] == "a" and runs == sweep.sweep(space, score)
