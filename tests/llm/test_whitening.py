"""Whitening against an eigendecomposition of the whole covariance."""

from fractions import Fraction

import numpy as np
import pytest

from verdigris.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n int"


def _plain(rows, keep=4):
    sound = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256.0 * float(np.float32(c)))) for c in v] for _, v in sound], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    out = {}
    for (i, _), v in zip(sound, x, strict=True):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        out.setdefault(i, (n, deviation, ((n * v - s) / n) @ u / np.sqrt(e)))
    trace = float(sum(Fraction(int(n * (fit[:, j] ** 2).sum() - s[j] ** 2), n * n) for j in range(len(s))))
    return out, e / trace


@pytest.mark.parametrize("small", [True, False])
def test_query(spark, tmp_path, small):
    d = SF
    if small:
        d = str(tmp_path)
        rng = np.random.default_rng(3)
        rows = [(i, [float(c) for c in rng.normal(size=5) * [5, 3, 2, 1, 0.5]], 1) for i in range(60)]
        rows += [(5, rows[5][1], 1), (100, rows[7][1], 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 5, 1), (203, [1.0, 2.0, float("inf"), 0.0, 0.0], 1), (204, [], 1), (205, [-0.0] * 5, 1)]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, explained = _plain(rows)
    got = queries.op12_embedding_whitening(spark, d).collect()
    assert {r["vec_id"] for r in got} == set(want)
    assert len(got) == 4 * sum(i in want for i, _ in rows)
    sign = {}
    for r in got:
        n, deviation, y = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(y[k]) > 1e-3:
            assert sign.setdefault(k, np.sign(y[k] * r["whitened"])) == np.sign(y[k] * r["whitened"])
        assert abs(abs(y[k]) - abs(r["whitened"])) < 1e-8
        assert abs(r["explained"] - explained[k]) < 1e-12
        assert r["identity_error"] < 1e-10 and r["residual"] < 1e-11


def test_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 2.0], 0), (2, [0.5, 2.0], 0), (None, [0.5, 2.0], 0), (3, [1.0], 0)], SCHEMA)
    got = [tuple(r) for r in whitening.whiten(same).collect()]
    assert sorted(got, key=str) == sorted([(i, k, 1, 0, None, None, None, 0.0) for i in (1, 2, None) for k in (1, 2)], key=str)
    # one direction of variance of three
    line = spark.createDataFrame([(i, [float(i), 0.0, 1.0], 0) for i in range(8)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is not None) == (r["component"] == 1) for r in got) and len(got) == 24
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in got)


def test_many_dimensions(spark):
    """More dimensions than a round's basis has directions, with close eigenvalues."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(400, 90)))]
    want, explained = _plain([(i, v) for i, v, _ in rows])
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), block=8).collect()
    assert max(abs(abs(want[r["vec_id"]][2][r["component"] - 1]) - abs(r["whitened"])) for r in got) < 1e-7
