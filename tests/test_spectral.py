"""Components of sparse rows against dense linear algebra; term weights by their formula."""

import math
from collections import Counter

import numpy as np
import pytest

from lexigraph.operators import spectral


@pytest.mark.parametrize("kind", ["decaying", "flat"])
def test_components(spark, kind):
    r = np.random.default_rng(1)
    d, k = 150, 50
    a = r.random((400, d)) * (r.random((400, d)) < 0.15)
    if kind == "decaying":
        a = (a @ np.diag(0.9 ** np.arange(d))).round(12)
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, at array<int>, x array<double>")
    mean, values, axes = spectral.components(df, d, k)
    c = a - a.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(a))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert np.allclose(mean, a.mean(0)) and np.allclose(values, e, rtol=1e-9, atol=1e-12)
    assert np.allclose(np.abs((axes * u).sum(0)), 1, atol=1e-8) and axes.shape == (d, k)
    got = np.array([x["pc"] for x in sorted(spectral.projected(df, mean, axes, "id").collect(), key=lambda x: x["id"])])
    assert np.allclose(np.abs(got), np.abs(c @ u), atol=1e-6)


def test_no_rows_and_few_columns(spark):
    df = spark.createDataFrame([(1, [0, 2], [1.0, 2.0]), (2, [], []), (3, [1], [5.0])], "id long, at array<int>, x array<double>")
    assert spectral.components(df.where("false"), 3, 2)[2].shape == (3, 0)
    mean, values, axes = spectral.components(df, 3, 9)
    a = np.array([[1.0, 0, 2], [0, 0, 0], [0, 5, 0]])
    assert axes.shape == (3, 3) and np.allclose(values, np.linalg.eigvalsh(np.cov(a.T, bias=True))[::-1], atol=1e-12)


def test_term_weights(spark):
    docs = {1: "b a a c", 2: "a b", 3: "", 4: "d d a"}
    df = spark.createDataFrame([(i, w) for i, t in docs.items() for w in (t.split() or [None])], "id long, w string")
    words, rows = spectral.tfidf(df, "id", "w", 3)
    at = {r["at"]: (r["w"], r["df"]) for r in words.collect()}
    assert [at[k] for k in range(3)] == [("a", 3), ("b", 2), ("c", 1)]
    got = {r["id"]: dict(zip(r["at"], r["x"], strict=True)) for r in rows.collect()}
    for i, t in docs.items():
        raw = {k: Counter(t.split())[w] * (math.log(5 / (1 + n)) + 1) for k, (w, n) in at.items() if w in t.split()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        assert got[i].keys() == raw.keys() and all(abs(got[i][k] - raw[k] / size) < 1e-12 for k in raw)


def test_few_columns_take_one_more_pass(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, sorted(map(int, r.choice(40, 5, replace=False))), r.random(5).tolist()) for i in range(90)] + [(90, [], [])]
    df = spark.createDataFrame(rows, "id long, at array<int>, x array<double>")
    passes, added = [], spectral.added
    monkeypatch.setattr(spectral, "added", lambda *a: passes.append(1) or added(*a))
    mean, values, axes = spectral.components(df, 40, 3)
    assert len(passes) == 2
    monkeypatch.setattr(spectral, "GRAM", 0)
    other = spectral.components(df, 40, 3)
    assert len(passes) > 4 and all(np.allclose(a, b, atol=1e-6) for a, b in zip((mean, values, axes), other, strict=True))
