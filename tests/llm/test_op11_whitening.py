import math

import numpy as np
import pytest

from pagewright.llm import op11_whitening as m
from tests.llm import edge

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int, deviation string"


def brute(vectors, components=8):
    """All by a whole eigendecomposition."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov((x - sums / n).T, bias=True))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ basis / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True))


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "d") for i, v in vectors], SCHEMA)


def test_query_equals_eigendecomposition(spark):
    p = m.op11_whiten(spark, "/root/testdata/sf0.01").toPandas().sort_values(["vec_id", "component"])
    e = edge.table(spark, "embeddings", "sf0.01").orderBy("vec_id").toPandas()
    deviation, whitened, explained = brute(e["embedding"].tolist())
    assert p["vec_id"].tolist() == [i for i in e["vec_id"] for _ in range(8)] and p["component"].tolist() == [*range(1, 9)] * len(e)
    assert (p["n"] == len(e)).all() and (p["deviation"] == np.repeat(deviation, 8)).all()
    got = p["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.abs(p["explained"].to_numpy().reshape(-1, 8) / explained - 1).max() < 1e-9
    assert p["identity_error"].nunique() == 1 and p["identity_error"][0] < 1e-9


def test_filter_finds_what_a_small_gap_separates():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.r_[np.linspace(9, 8, 9), np.linspace(7.99, 1, 191)], np.r_[[5, 5, 5], np.ones(197)], np.r_[np.arange(10, 0, -1.0), np.zeros(190)], np.linspace(100, 99, 200)):
        v = (basis * values) @ basis.T
        got, q, residual = m.leading(lambda q, v=v: v @ q, 200, 8)
        assert np.allclose(got, values[:8], atol=1e-8 * values[0]) and residual < 1e-11
        live = values[:8] > 0
        assert np.allclose(np.linalg.norm(v @ q - q * got, axis=0)[live], 0, atol=1e-9 * values[0]) and np.allclose(q.T @ q, np.eye(8), atol=1e-10)


def test_recurrence_is_the_chebyshev_polynomial():
    values = np.linspace(0, 10, 41)
    got = m.chebyshev(lambda q: values[:, None] * q, np.ones((41, 1)), 7, 1.0, 4.0, 10.0)[:, 0]
    t = lambda x: np.polynomial.chebyshev.chebval(x, [0] * 7 + [1])
    assert np.allclose(got, t((values - 2.5) / 1.5) / t((10 - 2.5) / 1.5))


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3)) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1, None, 2]), (103, [1, math.nan, 2]), (104, [1, math.inf, 2]), (105, [1.0] * 4), (None, [1, 2, 3]), (7, [1, 2, 3]), (7, [1, 2, 3])]
    p = m.whiten(frame(spark, rows + odd)).toPandas()
    assert p["component"].max() == 3 and len(p) == 3 * 43 and p["n"].unique().tolist() == [43]
    assert p["vec_id"].isna().sum() == 3 and (p["vec_id"] == 7).sum() == 9 and not p["vec_id"].isin(range(100, 106)).any()
    deviation, whitened, _ = brute([np.float32(v) for _, v in rows + odd[-3:]], 3)
    assert sorted(int(v) for v in p["deviation"]) == sorted(int(v) for v in np.repeat(deviation, 3))
    assert p["identity_error"].max() < 1e-9
    for empty in ([], [(1, None)], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])]):  # no rows, or no spread
        assert m.whiten(frame(spark, empty)).count() == 0
    flat = m.whiten(frame(spark, [(i, [i, 2 * i, 5]) for i in range(9)])).toPandas()
    assert len(flat) == 9 and flat["explained"].iloc[0] == pytest.approx(1)  # one dimension, so one component


def test_deviations_beyond_a_long():
    x = np.array([[3, 10**9], [5, -(10**9)]])
    assert [int(v.as_py()) for v in m.deviations(x, 10**6, [8, 0])] == [(3 * 10**6 - 8) ** 2 + 10**30, (5 * 10**6 - 8) ** 2 + 10**30]
    small = np.array([[1, 2], [3, 4]])
    assert [int(v.as_py()) for v in m.deviations(small, 2, [4, 6])] == [8, 8]
