"""Forward scans and exact quantiles over ranges, against plain loops."""

import numpy as np
import pytest

from lexigraph.operators import learning, order, sequences


@pytest.mark.parametrize("inclusive", [True, False])
def test_windows_over_several_blocks(spark, inclusive):
    r = np.random.default_rng(9)
    sizes = {"a": 60, "b": 1, None: 23, "": 8}
    rows, vectors = [], {}
    for g, n in sizes.items():
        walk = np.cumsum(r.normal(size=(n, 4)) * 0.35, axis=0) + 3 * r.normal(size=4)
        for p, v in enumerate(walk / np.linalg.norm(walk, axis=1, keepdims=True), 1):
            rows.append((g, len(rows), p, v.tolist()))
            vectors[g, p] = v
    e = spark.createDataFrame(rows, "g string, id long, pos long, u array<double>")
    theta = [0.2, -0.4, -1.0, 0.9]
    similar = lambda s, t: s >= t if inclusive else s > t
    got = {(x["theta"], x["g"], x["pos"]): x["window"] for x in sequences.attention_windows(e, theta, inclusive, block=7).collect()}
    assert len(got) == 4 * len(rows)
    for t in theta:
        for g, n in sizes.items():
            for p in range(1, n + 1):
                w = 0
                while p + w + 1 <= n and similar(vectors[g, p] @ vectors[g, p + w + 1], t):
                    w += 1
                assert got[t, g, p] == w
    assert sequences.attention_windows(e.where("false"), theta, inclusive).count() == 0
    assert {x["window"] for x in sequences.attention_windows(e.where("g = 'b'"), [0.5]).collect()} == {0}


def test_quantiles(spark):
    r = np.random.default_rng(2)
    values = {"x": r.integers(0, 9, 101), "y": r.normal(size=40), None: np.array([3.0]), "z": np.array([])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("z", None), ("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {x["g"]: x["q"] for x in order.quantiles(df, "v", probs, ["g"]).collect()}
    assert got.keys() == {"x", "y", None} and all(np.allclose(got[g], np.quantile(values[g], probs)) for g in got)
    whole = order.quantiles(df, "v", probs).collect()
    assert len(whole) == 1 and np.allclose(whole[0]["q"], np.quantile([v for _, v in rows if v is not None], probs))
    assert order.quantiles(df.where("v is null"), "v", probs).first()["q"] is None


def test_mixed_model_from_sums_by_size(spark):
    """Against EM over the groups themselves."""
    r = np.random.default_rng(3)
    rows = [(g, float(x := r.normal()), float(1 - x + e + r.normal())) for g in range(25) for e in [r.normal()] for _ in range(2 + g % 4)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    m = learning.mixed_model(df, "y", ["x"], "g", rounds=30)
    groups = [(np.array([[1.0, x] for h, x, _ in rows if h == g]), np.array([y for h, _, y in rows if h == g])) for g in range(25)]
    xs, ys = np.concatenate([a for a, _ in groups]), np.concatenate([b for _, b in groups])
    beta = np.linalg.lstsq(xs, ys, rcond=None)[0]
    s2 = ((ys - xs @ beta) ** 2).mean()
    t2 = s2 / 10
    for _ in range(30):
        k = [t2 / (s2 + len(b) * t2) for _, b in groups]
        left = xs.T @ xs - sum(c * np.outer(a.sum(0), a.sum(0)) for c, (a, _) in zip(k, groups, strict=True))
        beta = np.linalg.solve(left, xs.T @ ys - sum(c * a.sum(0) * b.sum() for c, (a, b) in zip(k, groups, strict=True)))
        u = [c * (b - a @ beta).sum() for c, (a, b) in zip(k, groups, strict=True)]
        v = [t2 * s2 / (s2 + len(b) * t2) for _, b in groups]
        t2 = np.mean([p * p + q for p, q in zip(u, v, strict=True)])
        s2 = sum(((b - a @ beta - p) ** 2).sum() + len(b) * q for p, q, (a, b) in zip(u, v, groups, strict=True)) / len(ys)
    assert np.allclose([*m["beta"], m["sigma2"], m["tau2"]], [*beta, s2, t2], rtol=1e-9)
    got = {x["g"]: x["effect"] for x in learning.blups(df, "y", ["x"], "g", m).collect()}
    assert all(abs(got[g] - t2 * (b - a @ beta).sum() / (s2 + len(b) * t2)) < 1e-9 for g, (a, b) in enumerate(groups))
