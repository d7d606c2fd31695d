"""Whitening against dense linear algebra over the whole table."""

import numpy as np
import pytest

from lexigraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def dense(vectors, k=4):
    """(n, S, eigenvalues, eigenvectors, V) of the distinct scaled vectors."""
    x = np.unique(np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64), axis=0)
    n, s = len(x), x.sum(0)
    a = x - s / n
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    return n, s, e[::-1][:k], u[:, ::-1][:, :k], v


def frame(spark, vectors, more=()):
    rows = [(i, [None if c is None else float(c) for c in v], i % 3, 7, "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def check(df, vectors, rows, tolerance=1e-9):
    n, s, e, u, v = dense(vectors)
    got = {(r["id"], r["component"]): r for r in rows}
    for i, c in enumerate(vectors):
        x = np.floor(256 * np.asarray(c, np.float32).astype(float)).astype(np.int64)
        z = (x - s / n) @ u / np.sqrt(e)
        far = sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        for k in range(len(e)):
            r = got[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, far)
            assert abs(abs(r["whitened"]) - abs(z[k])) < tolerance * (1 + abs(z[k]))
            assert abs(r["explained"] - e[k] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9
    for k in range(len(e)):  # one sign for all rows
        w = np.array([got[i, k + 1]["whitened"] for i in range(len(vectors))])
        z = (np.floor(256 * np.asarray(vectors, np.float32).astype(float)) - s / n) @ u[:, k]
        assert abs(abs(w @ z) - np.linalg.norm(w) * np.linalg.norm(z)) < 1e-6 * np.linalg.norm(w) * np.linalg.norm(z)


@pytest.mark.parametrize("kind", ["decaying", "flat", "narrow"])
def test_against_dense(spark, kind):
    r = np.random.default_rng(4)
    d = {"decaying": 40, "flat": 48, "narrow": 3}[kind]
    x = r.normal(size=(300, d)) * (0.6 ** np.arange(d) if kind == "decaying" else 1.0)
    x = [*x, *[x[0]] * 150]  # copies don't weigh
    df = frame(spark, x)
    check(df, x, whitening.whiten(df, 4).collect())


def test_block_grows_only_where_residuals_fail(spark):
    r = np.random.default_rng(5)
    steep, flat = r.normal(size=(200, 40)) * 0.2 ** np.arange(40), r.normal(size=(200, 40))
    fit = [whitening.Fit(whitening.scaled(frame(spark, x), "vec_id", "embedding").select("x").distinct(), 4) for x in (steep * 100, flat)]
    assert set(fit[0].widths) == {12} and fit[1].widths[-1] == 40


def test_odd_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 5)).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, 0, 0, ""), (101, [1.0, None, 0.0, 0.0, 0.0], 0, 0, ""), (102, [nan] * 5, 0, 0, ""), (103, [0.0, -inf, 0.0, 0.0, 0.0], 0, 0, "")]
    odd = [(None, x[0], 0, 0, ""), (3, x[3], 0, 0, ""), (200, [0.25], 0, 0, ""), (201, [], 0, 0, "")]
    got = whitening.whiten(frame(spark, x, bad + odd), 4).collect()
    assert {v["id"] for v in got} == {*range(60), None, 200, 201} and len(got) == (60 + 4) * 4
    filled = [*x, [0.25, 0, 0, 0, 0], [0.0] * 5]
    at = {v["id"]: v["deviation"] for v in got}
    n, s, *_ = dense(filled)
    assert [at[200], at[201]] == [sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for v in ([64, 0, 0, 0, 0], [0] * 5)]
    assert len({(v["component"], v["whitened"]) for v in got if v["id"] in (3,)}) == 4


def test_nothing_to_whiten(spark):
    empty = frame(spark, []).where("false")
    assert whitening.whiten(empty, 4).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5), 4).count() == 0  # no variance
    assert whitening.whiten(frame(spark, [[]] * 3), 4).count() == 0
    line = whitening.whiten(frame(spark, [[float(i), 2.0 * i] for i in range(9)]), 4).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9


def test_deviation_past_a_long_is_null(spark):
    got = {(r["id"], r["component"]): r for r in whitening.whiten(frame(spark, [[3e30, 0.0], [-3e30, 1.0], [0.0, 2.0], [1.0, 5.0]]), 4).collect()}
    assert got[0, 1]["deviation"] is None and got[2, 1]["deviation"] == sum((4 * a - b) ** 2 for a, b in zip((0, 512), (256 - 1, 256 * 8), strict=True))
