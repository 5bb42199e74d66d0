"""Whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest

from tabloom.llm.catalog import QUERIES
from tabloom.llm.whitening import WhitenSettings, bidiagonalise, whiten


def product(a):
    def run(y):
        p = a @ y
        return float(p @ p), a.T @ p, float((a * a).sum())

    return run


RNG = np.random.default_rng(0)
Q = np.linalg.qr(RNG.standard_normal((120, 120)))[0]
CASES = {
    "flat": RNG.standard_normal((500, 64)),
    "falling": RNG.standard_normal((800, 200)) * 0.8 ** np.arange(200),
    "low rank": RNG.standard_normal((300, 5)) @ RNG.standard_normal((5, 40)),
    "all equal values": np.vstack([np.eye(50) * 3] * 4),
    "repeated values": Q[:, :120] @ np.diag(np.r_[[5.0] * 10, [3.0] * 30, 0.01 * np.ones(80)]) @ Q.T,
    "fewer rows": RNG.standard_normal((7, 30)),
    "nothing": np.zeros((10, 4)),
}


@pytest.mark.parametrize("name", CASES)
def test_components_of_matrices(name):
    a = CASES[name]
    got = bidiagonalise(product(a), a.shape[1])
    values = np.linalg.eigvalsh(a.T @ a)[::-1]
    want = values[:32][values[:32] > 1e-18 * max(values[0], 1e-300)]
    want = want[want > 1e-12 * max(values[0], 1e-300)]
    assert len(got.singular) == len(want)
    if len(want):
        assert np.allclose(got.singular**2, want, rtol=1e-10)
        assert np.abs(got.vectors.T @ got.vectors - np.eye(len(want))).max() < 1e-12
        assert np.abs(a.T @ (a @ got.vectors) - got.vectors * got.singular**2).max() < 1e-12 * want[0]


def reference(vectors):
    """By numpy from (id, x) with exact integers: deviations, eigenvalues, vectors."""
    x = np.array(vectors, object)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    a = (far / n).astype(float)
    e, v = np.linalg.eigh(a.T @ a / n)
    return n, (far**2).sum(axis=1), a, e[::-1], v[:, ::-1]


def test_query_against_eigenvectors(spark, sf):
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in raw]
    x = [[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in raw]
    n, deviation, a, e, v = reference(x)
    k = min(32, len(x[0]))
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op13_whitening"](spark, sf).collect()}
    assert len(got) == n * k
    white = a @ v[:, :k] / np.sqrt(e[:k])
    mine = np.array([[got[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    mine *= np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white).max() < 1e-7
    one = got[ids[0], 1]
    assert one["n"] == n and one["identity_error"] < 1e-9
    for i, d in zip(ids, deviation):
        assert {got[i, j + 1]["deviation"] for j in range(k)} == {d}
    for j in range(k):
        assert got[ids[0], j + 1]["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-9)


def test_odd_vectors_and_clashing_columns(spark):
    good = [[1.0, 2.5, -3.25], [0.0, 0.0, 0.0], [1.0, 2.5, -3.25], [-7.0, 0.01, 1e6], [5.5, -0.001, 2.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0], [1.0] * 4]
    rows = [(i, u, i, "c") for i, u in enumerate(good + bad)] + [(None, good[0], 1, "c"), (1, good[4], 1, "c")]
    frame = spark.createDataFrame(rows, "id int, vector array<double>, n int, x string").repartition(4)
    used = good + [good[0], good[4]]
    x = [[math.floor(64 * c) + 1_000_000 for c in u] for u in used]
    n, deviation, a, e, v = reference(x)
    got = whiten(frame).collect()
    assert len(got) == 3 * n and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    y = np.array([[r["whitened"] for r in got if r["component"] == j + 1] for j in range(3)]).T
    assert np.abs(y.T @ y / n - np.eye(3)).max() < 1e-9
    assert sorted(np.abs(y[:, 0])) == pytest.approx(sorted(np.abs(a @ v[:, 0] / np.sqrt(e[0]))))
    assert sum(r["id"] is None for r in got) == 3
    two = whiten(frame, settings=WhitenSettings(components=2)).collect()
    assert {r["component"] for r in two} == {1, 2}


def test_nothing_to_whiten(spark):
    kind = "id long, vector array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(spark.createDataFrame(rows, kind)).count() == 0
