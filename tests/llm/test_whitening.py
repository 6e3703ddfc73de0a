from __future__ import annotations

import math

import numpy as np
import pytest

from lodestar.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, some):
    """The fit list, its covariance and eigenvectors in plain numpy; deviations in Python's integers."""
    xs = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted({x for x in xs if x is not None})
    n, d = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], np.float64) / n
    v = centred.T @ centred / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1], u[:, ::-1]
    deviations = [None if x is None else sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    white = [None if x is None else (np.array([n * a - s for a, s in zip(x, sums, strict=True)], np.float64) / n) @ u[:, :some] / np.sqrt(values[:some]) for x in xs]
    return n, values, v, deviations, white


def test_query_equals_plain_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, values, v, deviations, white = plain([r["embedding"] for r in rows], 16)
    got = queries.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * sum(x is not None for x in deviations) and set(got["n"]) == {n}
    by = {i: g for i, g in got.groupby("vec_id")}
    table = np.array([by[r["vec_id"]]["whitened"].to_numpy() for r, x in zip(rows, deviations, strict=True) if x is not None])
    want = np.array([w for w in white if w is not None])
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-6
    for r, x in zip(rows, deviations, strict=True):
        assert x is None or set(by[r["vec_id"]]["deviation"]) == {x}
    assert np.allclose(by[rows[0]["vec_id"]]["explained"], values[:16] / np.trace(v), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def residual(v, values, x):
    return np.abs(v @ x - x * values).max() / np.abs(values).max(), np.abs(x.T @ x - np.eye(len(v))).max()


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-12, 0.0])
def test_clusters_are_told_apart(gap):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.r_[5 + gap * np.arange(4), 3 + gap * np.arange(3), np.linspace(0.01, 2, 33)]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.eigen(v)
    off, skew = residual(v, got, x)
    assert off < 2e-15 and skew < 1e-14 and np.allclose(got, np.sort(values)[::-1], rtol=1e-13)


def test_refinement_gains_on_float32():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(64, 200)) * rng.uniform(0.1, 5, (64, 1))
    v = a @ a.T / 200
    w, rough = np.linalg.eigh(v.astype(np.float32))
    got, x = whitening.eigen(v)
    assert residual(v, got, x)[0] < 1e-15 < 1e-9 < residual(v, w.astype(float), rough.astype(float))[0]
    whole = np.linalg.eigh(v)[1][:, ::-1]
    assert np.abs(np.abs((whole * x).sum(axis=0)) - 1).max() < 1e-12


def test_edges(spark):
    schema = "vec_id string, embedding array<double>, x int, key string, n long, place int"
    some = [(None, [1.0, 2.0, 3.0]), ("a", [1.0, 2.0, 3.0]), ("b", [0.5, -1.0, 3.0]), ("c", [0.25, 8.0, 3.0]), ("d", None), ("e", [1.0, None, 2.0]), ("f", [float("nan")] * 3), ("g", [float("inf"), 0.0, 0.0]), ("h", []), ("b", [0.5, -1.0, 3.0])]
    rows = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in some], schema)
    got = whitening.whiten(rows).toPandas()
    assert len(got) == 5 * 3 and set(got["n"]) == {3}
    assert got[got["component"] == 3]["whitened"].isna().all() and got[got["component"] < 3]["whitened"].notna().all()  # the third dimension is constant
    assert got["identity_error"].max() < 1e-12
    n, _, _, deviations, _ = plain([r[1] if r[1] else None for r in some], 2)
    assert set(got[got["vec_id"] == "c"]["deviation"]) == {deviations[3]}
    assert whitening.whiten(rows.limit(0)).count() == 0 and whitening.whiten(rows.filter("vec_id = 'h'")).count() == 0
    same = whitening.whiten(rows.filter("vec_id = 'a'")).toPandas()
    assert same["whitened"].isna().all() and (same["deviation"] == 0).all() and (same["explained"] == 0).all()
    with pytest.raises(ValueError, match="same length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_deviation_that_does_not_fit_raises():
    with pytest.raises(OverflowError):
        whitening.Centre(10**9, [0]).deviation(np.array([[10**6]]))
