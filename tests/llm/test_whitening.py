"""Whitening against an eigenvalue decomposition, and what has no component."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from papyrine.llm import queries, whitening

D = "/root/testdata/sf0.01"


def plain(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], v[:, ::-1]


def test_query(spark):
    t = pq.read_table(f"{D}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    n, s, e, v = plain(x)
    want = (x - s / n) @ v[:, :4] / np.sqrt(e[:4])
    found = queries.queries()["op13_whitening"](spark, D).collect()
    assert len(found) == 4 * len(rows)
    got = {(r.vec_id, r.component): r for r in found}
    for k in range(4):
        own = np.array([got[i, k + 1].whitened for i, _ in rows])
        assert np.abs(own * np.sign(own @ want[:, k]) - want[:, k]).max() < 1e-9
        assert all(abs(got[i, k + 1].explained - e[k] / e.sum()) < 1e-12 for i, _ in rows)
    deviation = ((n * x - s) ** 2).sum(1).tolist()
    assert all(got[i, 1].deviation == d and got[i, 1].n == n and got[i, 1].identity_error < 1e-10 for (i, _), d in zip(rows, deviation, strict=True))


def test_tree_and_rotations_on_hard_numbers():
    """Columns over ten orders of magnitude keep their small deviations; a fan-in of two and tiny blocks change nothing."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    x = rng.standard_normal((400, 5)) * np.array([1e6, 1e3, 1, 1e-2, 1e-4])
    x = np.linalg.qr(x)[0] * np.array([1e6, 1e3, 1, 1e-2, 1e-4]) @ turn.T
    r = np.zeros((0, 5))
    for at in range(0, 400, 7):
        r = whitening.triangle(np.vstack([r, x[at : at + 7]]))
    values, vectors = whitening.jacobi(r)
    assert np.allclose(values[:3], [1e6, 1e3, 1], rtol=1e-9) and np.allclose(values[3:], [1e-2, 1e-4], rtol=1e-3)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-13


def test_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(1, [0.0, 0.5, 1.0]), (1, [0.0, 0.5, 1.0]), (2, [1.0, 0.5, -1.0]), (3, [2.0, 0.5, 0.25]), (None, [0.5, 0.5, 0.5])]
    bad = [(4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [1e300, 0.0, 0.0])]
    others = [(20, [1.0, 2.0]), (21, [3.0, -1.0]), (30, [7.0])]  # two more lengths; of one there is one vector only
    df = spark.createDataFrame(rows + bad + others, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "x", "d", "component")})
    found = whitening.whiten(df).collect()
    three = [r for r in found if r.n == 4]
    assert sorted({(r.vec_id is None, r.vec_id) for r in three}) == [(False, 1), (False, 2), (False, 3), (True, None)]
    assert len(three) == 5 * 2 and {r.component for r in three} == {1, 2}  # the middle entry never changes
    assert {r.vec_id for r in found if r.n == 2} == {20, 21} and not any(r.vec_id in (4, 5, 6, 7, 8, 9, 30) for r in found)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    n, s, e, v = plain(x)
    by = {(r.vec_id, r.component): r.whitened for r in three}
    assert np.allclose(np.abs([by[3, 1], by[3, 2]]), np.abs((x[3] - s / n) @ v[:, :2] / np.sqrt(e[:2])))


def test_deviation_beyond_64_bits():
    x = np.array([[2**40, -5], [3, 4]], np.int64)
    assert whitening.exact_deviation(x, 10, [7, 9]) == [None, (30 - 7) ** 2 + (40 - 9) ** 2]
    big = np.array([[2**30, 1]], np.int64)
    assert whitening.exact_deviation(big, 2, [1, 1]) == [(2**31 - 1) ** 2 + 1]


@pytest.mark.parametrize("parts", [1, 40])
def test_many_partitions(spark, parts):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * (1, 2, 3, 4, 5, 6)).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    fit = whitening.scaled(df).select("d", "x")
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    n, s, e, _ = plain(x)
    r = whitening.compressed(fit, s / n, block=16, fan_in=2)
    assert np.allclose(whitening.jacobi(r)[0] ** 2 / n, e, rtol=1e-10)
