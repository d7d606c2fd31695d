"""Regressions against numpy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph import queries as core
from lexigraph.functions import stats as S
from lexigraph.queries import learning as Q
from lexigraph.queries.vectors import transitions

SF = "/root/testdata/sf0.001"
QUERIES = core.queries()


def ols(x, y):
    a = np.c_[x, np.ones(len(x))]
    beta = np.linalg.solve(a.T @ a, a.T @ y)
    rest = y - a @ beta
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / (len(y) - a.shape[1]))
    return beta, se, 1 - rest @ rest / ((y - y.mean()) ** 2).sum()


def logit(x, y, rounds=40):
    a = np.c_[x, np.ones(len(x))]
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ beta))
        h = a.T @ (a * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, a.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_ols(spark):
    rows = np.array(Q.tabular(spark, SF).select("q", "disc", "tax", "y").collect(), float)
    beta, se, r2 = ols(rows[:, :3], rows[:, 3])
    got = QUERIES["i16_ols_controls"](spark, SF).collect()
    assert [r["term"] for r in got] == ["q", "disc", "tax", "1"]
    assert np.allclose([r["beta"] for r in got], beta, rtol=1e-6, atol=1e-4) and np.allclose([r["se"] for r in got], se, rtol=1e-6) and all(abs(r["r2"] - r2) < 1e-9 for r in got)


def test_logit_and_odds(spark):
    e = transitions(spark, SF).select((F.col("sim") < 0).cast("double"), (F.col("kind") != F.col("kind2")).cast("double"), (F.col("pos") - 0.5) / (F.col("n") - 1), "kind", "kind2").collect()
    e = np.array([list(map(float, r)) for r in e])
    got = {(r["model"], r["term"]): (r["beta"], r["se"], r["p"]) for r in QUERIES["i17_logit"](spark, SF).collect()}
    beta, se = logit(e[:, 1:2], e[:, 0])
    assert np.allclose([got["M1", t][:2] for t in ("sw", "1")], np.c_[beta, se], rtol=1e-5, atol=1e-6)
    assert all(abs(p - S.normal_tail(b / s)) < 1e-5 for b, s, p in got.values())
    # which kind is the base of the dummies doesn't change the other terms
    dummies = np.c_[e[:, 1], e[:, 2], e[:, 2] ** 2, *(e[:, c] == k for c in (3, 4) for k in (1, 2))]
    beta, se = logit(dummies, e[:, 0])
    assert np.allclose([got["M2", t][:2] for t in ("sw", "rel", "rel2")], np.c_[beta, se][:3], rtol=1e-4, atol=1e-5) and len(got) == 10
    odds = {(r["model"], r["term"]): (r["odds"], r["lo"], r["hi"]) for r in QUERIES["i20_odds_ratios"](spark, SF).collect()}
    assert all(np.allclose(odds[k], np.exp([b, b - 1.959964 * s, b + 1.959964 * s]), atol=1e-5) for k, (b, s, _) in got.items())


def test_treatment_effect(spark):
    rows = np.array(Q.tabular(spark, SF).select("q", "tax", "disc", "y").collect(), float)
    x, w, y = rows[:, :2], rows[:, 2] > 0.05, rows[:, 3]
    beta, _ = logit(x, w.astype(float))
    e = np.clip(1 / (1 + np.exp(-np.c_[x, np.ones(len(x))] @ beta)), 0.01, 0.99)
    m = [np.c_[x, np.ones(len(x))] @ ols(x[w == k], y[w == k])[0] for k in (False, True)]
    got = QUERIES["i30_treatment_effect"](spark, SF).first()
    assert got["naive"] == pytest.approx(y[w].mean() - y[~w].mean(), abs=1e-3)
    assert got["doubly_robust"] == pytest.approx((m[1] - m[0] + w * (y - m[1]) / e - ~w * (y - m[0]) / (1 - e)).mean(), rel=1e-3, abs=0.5)
