"""Whitening against a direct computation, and the refined eigenvectors by themselves."""

import math
from fractions import Fraction

import numpy as np
import pytest

from trialspark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def direct(rows, k=4):
    """{id: [(component, n, deviation, |whitened|, explained)]} of vectors of one length, in plain NumPy."""
    kept = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in kept:
        z = (np.array(x) - s / n) @ q[:, :k] / np.sqrt(e[:k])
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
        out.setdefault(i, []).extend((c + 1, n, dev, abs(float(z[c])), float(e[c] / e.sum())) for c in range(k))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append((r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        for g, w in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    spread = np.linspace(1, 0.05, 12)
    out = [(i, (rng.normal(0, 1, 12) * spread + 0.3).astype(np.float32).tolist()) for i in range(400)]
    out += [(400 + i, out[i % 3][1]) for i in range(150)]  # copies count once
    out += [(600, None), (601, [float("nan")] * 12), (602, [None] + [0.0] * 11), (603, [float("inf")] + [0.0] * 11), (604, [-0.0] * 12), out[5]]
    return out


def test_against_numpy(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = wh.whiten(df)
    same(found(got), direct(rows))
    assert {r["identity_error"] for r in got.select("identity_error").distinct().collect()}.pop() < 1e-12


def test_order_of_rows_does_not_matter(spark, rows):
    frames = (spark.createDataFrame([(i, v, 0) for i, v in r], SCHEMA).repartition(p) for r, p in ((rows, 1), (rows[::-1], 7)))
    a, b = (sorted(tuple(r)[:6] for r in wh.whiten(f).collect()) for f in frames)
    assert a == b  # to the last bit


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wh.whiten(empty).collect() == []
    one = spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0), (3, [], 0)], SCHEMA)
    got = sorted(tuple(r) for r in wh.whiten(one).collect())
    assert got == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    lengths = spark.createDataFrame([(i, [float(i), float(i * i)], 0) for i in range(5)] + [(9 + i, [float(i)] * 3, 0) for i in range(4)], SCHEMA)
    got = {(r["vec_id"], r["component"]): r for r in wh.whiten(lengths).collect()}
    assert len(got) == 5 * 2 + 4 * 3
    assert got[9, 2]["whitened"] is None and got[9, 2]["explained"] == 0 and got[9, 1]["explained"] == pytest.approx(1)
    huge = spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [3e12, 0.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 5.0], 0)], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(huge).collect()}
    assert set(got) == {2, 3, 4} and got[2] is None


def test_clashing_columns(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    names = ("id", "vector", "length", "x", "component", "n", "whitened", "i", "j", "v")
    same(found(wh.whiten(df.withColumns({c: F.lit("z") for c in names}))), direct(rows))


def residual(a, values, x):
    a = a.astype(np.longdouble)
    return float(np.abs(a @ x - x * values).max()), float(np.abs(x.T @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("values", [
    np.linspace(1, 0.01, 40),
    np.r_[1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, np.linspace(0.5, 0.1, 36)],  # closer than float32 can tell
    np.r_[np.ones(20), np.full(20, 0.25)],
    np.r_[1.0, np.zeros(39)],
    10.0 ** -np.arange(40.0) ** 0.5,
])
def test_refined_vectors(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    q = q + q @ (np.eye(len(q)) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = wh.eigen(a)
    assert np.all(np.diff(e) <= 0)
    wrong, skew = residual(a, e, x)
    assert wrong < 1e-17 and skew < 1e-17
    assert np.allclose(np.sort(e.astype(float)), np.sort(values), rtol=0, atol=1e-16)


def test_close_eigenvalues_keep_their_vectors():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(2):
        q = q + q @ (np.eye(30) - q.T @ q) / 2
    values = np.r_[1, 1 - 1e-8, 1 - 2e-8, np.linspace(0.5, 0.1, 27)].astype(np.longdouble)
    a = (q * values) @ q.T
    e, x = wh.eigen((a + a.T) / 2)
    assert float(np.abs(np.abs((x * q).sum(axis=0)) - 1).max()) < 1e-16
    assert float((x - q * np.sign((x * q).sum(axis=0))).__abs__().max()) < 1e-10


def test_products_are_exact():
    y = np.array([[1 << 40, 3], [-(1 << 40), 5], [7, 1 << 40]])
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert wh._products(y).tolist() == want
    small = np.random.default_rng(0).integers(-3000, 3000, (500, 6))
    assert (wh._products(small) == small.T @ small).all()
    assert float(wh._exact(Fraction(1, 3))) == 1 / 3
