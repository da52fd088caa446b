"""Whitening of embeddings by LOBPCG (Knyazev, 2001), with covariance products over rows that stay where they are.

Entries become long x = floor(256 c).  The fit list holds each distinct x vector once, in a table of the shared folder.
The covariance V of the fit list is never formed: a round multiplies it with a block of directions, as the sum over centred
rows of x (x . W), one small partial block a task, added up by Spark.  Each round takes Rayleigh-Ritz over iterate,
residual and previous directions; at the end a product with the vectors themselves certifies their residuals.  The driver
holds blocks of d x 3 `block`, whatever the number of rows.

A row is dropped where its vector is null, empty or holds a null or non-finite entry, and where its length is not that of
most such rows (ties: the longer).  Repeated rows each have their results; a null vec_id is kept.  A component without
variance (within rounding) has null `whitened`, and explained null if nothing varies at all; identity_error speaks of the
others, and is null without any.  Vectors of fewer than `keep` entries have as many components as entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch

#: Residuals as a share of the largest eigenvalue: what is aimed at, and the most that is accepted where rounding ends it.
AIM, ACCEPTED = 1e-14, 1e-11


def _x_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that are kept."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    sound = rows.select("vec_id", entries.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0))
    # a comparison with null is null, and NaN is above infinity
    sound = sound.where(F.coalesce(F.forall("c", lambda v: F.abs(v) < float("inf")), F.lit(False)))
    return sound.select("vec_id", F.transform("c", lambda v: F.floor(v * 256)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(table: DataFrame, cells: int, of) -> np.ndarray:
    """Sum over tasks and rows of of(x block), an array of so many doubles: added up within tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                total += of(b.column(0)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(total)], ["cell", "v"])

    out = np.zeros(cells)
    for r in table.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


class Fit:
    """n x-vectors with sums S, trace of the covariance, components (columns of u) and their eigenvalues e."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.s = np.array(sums, np.int64)
        self.variance = np.array([(n * q - s * s) / (n * n) for q, s in zip(squares, sums, strict=True)])
        self.trace = float(sum(n * q - s * s for q, s in zip(squares, sums, strict=True))) / (n * n)

    def product(self, table: DataFrame, w: np.ndarray) -> np.ndarray:
        """V w over the rows."""
        d, n, s = self.d, self.n, self.s

        def of(column: pa.Array) -> np.ndarray:
            c = (n * _matrix(column, d) - s) / n
            return c.T @ (c @ w)

        return _sums(table, d * w.shape[1], of).reshape(d, -1) / n

    def identity_error(self, table: DataFrame) -> float | None:
        """Largest absolute entry of the whitened fit list's covariance minus the identity."""
        d, n, s = self.d, self.n, self.s
        good = self.e > self.rank
        k = int(good.sum())
        if not k:
            return None
        map_ = self.u[:, good] / np.sqrt(self.e[good])

        def of(column: pa.Array) -> np.ndarray:
            y = ((n * _matrix(column, d) - s) / n) @ map_
            return np.r_[y.sum(0), (y.T @ y).ravel()]

        total = _sums(table, k + k * k, of) / n
        return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def _basis(x: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Orthonormal basis of the parts' columns beside those of x, each freed twice of those before; directions that add
    nothing are left out."""
    q = x
    for p in parts:
        size = np.linalg.norm(p, axis=0)
        p = p[:, size > 0] / size[size > 0]
        for _ in range(2):
            if p.shape[1]:
                p = p - q @ (q.T @ p)
                left, sv, _right = np.linalg.svd(p, full_matrices=False)
                p = left[:, sv > 1e-8]
        q = np.hstack([q, p])[:, : x.shape[0]]
    return q


def lobpcg(fit: Fit, table: DataFrame, keep: int, block: int, rounds: int) -> None:
    """Sets fit.u and fit.e to the `keep` greatest eigenpairs, from `block` directions; raises if they are not certified.
    A round multiplies its whole basis over the rows, so that no error is handed from one to the next."""
    d = fit.d
    m, k = min(block, d), min(keep, d)
    # the start does not hang on the data's order: the axes of greatest variance, turned a little
    start = np.eye(d)[:, np.argsort(-fit.variance, kind="stable")[:m]] + 0.01 * np.random.default_rng(7).standard_normal((d, m))
    q, old, best, since = np.linalg.qr(start)[0], 0, (np.inf, None, None), 0
    for _ in range(rounds):
        vq = fit.product(table, q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        x, vx = q @ turn, vq @ turn
        r = vx - x * e
        worst, top = float(np.linalg.norm(r[:, :k], axis=0).max()), max(float(e[0]), 0.0)
        since = 0 if worst < best[0] / 2 else since + 1
        if worst < best[0]:
            best = (worst, x[:, :k], e[:k])
        if worst <= AIM * top or (since >= 3 and best[0] <= ACCEPTED * top):
            break
        # previous directions: the step without its part in the iterate
        step = turn.copy()
        step[:old] = 0
        q, old = _basis(np.linalg.qr(x)[0], [r, q @ step] if old else [r]), m
    # the certificate is a product with the vectors themselves
    u = np.linalg.qr(best[1])[0]
    vu = fit.product(table, u)
    e, turn = np.linalg.eigh((u.T @ vu + vu.T @ u) / 2)
    fit.u, fit.e = u @ turn[:, ::-1], e[::-1]
    fit.residual = float(np.linalg.norm(vu @ turn[:, ::-1] - fit.u * fit.e, axis=0).max())
    fit.rank = 1e-10 * fit.trace
    if fit.residual > ACCEPTED * max(float(fit.e[0]), 0.0) and fit.trace > 0:
        raise RuntimeError(f"residuals of {fit.residual} after {rounds} rounds are not certified")


def whiten(rows: DataFrame, keep: int = 4, block: int = 16, rounds: int = 500) -> DataFrame:
    """rows: vec_id, embedding.  One row for each vector that is kept and each of the first `keep` components: vec_id,
    component from 1, n and deviation (exact), whitened, explained, identity_error, residual (certified, as a share of the
    first eigenvalue).  More directions than components (`block`) make fewer rounds.  deviation is a long: where n^2 times
    the vectors' squares pass 2^63, an error says so."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
    schema = schema.replace("vec_id bigint", f"vec_id {rows.schema['vec_id'].dataType.simpleString()}")
    kept = _x_vectors(rows)
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    kept = kept.where(F.size("x") == d)
    table = scratch.keep(kept.select("x").distinct(), "fit")
    exact = table.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,0)")).alias("q"))
    found = sorted(exact.collect())
    fit = Fit(found[0]["n"], [r["s"] for r in found], [int(r["q"]) for r in found])
    lobpcg(fit, table, keep, block, rounds)
    error = fit.identity_error(table)
    n, s, k = fit.n, fit.s, len(fit.e)
    scale = np.where(fit.e > fit.rank, 1 / np.sqrt(np.maximum(fit.e, 1e-300)), np.nan)
    share = [float(e) / fit.trace if fit.trace > 0 else None for e in fit.e]
    map_, residual = fit.u, fit.residual / float(fit.e[0]) if fit.e[0] > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d)
            away = n * x - s
            if float(np.square(away.astype(np.float64)).sum(1).max()) >= 2.0**63:
                raise OverflowError("deviation does not fit a long")
            rows = len(x)
            y = ((away / n) @ map_) * scale
            ids = b.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            flat = y.ravel()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()), pa.array(np.repeat(np.square(away).sum(1), k), pa.int64()),
                 pa.array(flat, mask=np.isnan(flat)), pa.array(share * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()), pa.array([residual] * (rows * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return kept.mapInArrow(run, schema)
