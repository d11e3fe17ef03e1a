"""Whitening of vectors by a one-sided Jacobi SVD over a blockwise TSQR.

A sound vector's entries become whole numbers x = floor(SCALE * c). The fit list holds each distinct x once.
Its rows, centred by S / n, are compressed to a triangle R: every task folds its rows block by block into one
R (a QR of R above the block), and a reduction tree of FAN_IN R's a node leaves one of d x d numbers, whatever
the table's size. Plane rotations make R's columns orthogonal; the columns' lengths over sqrt(n) are the
standard deviations and the accumulated rotations the components. No covariance is formed on the way, so small
deviations keep their digits. Only R, the sums and the components, all bounded by the dimension, meet the driver.

Sound vectors have a finite number in every entry, all of them within 64 bits once scaled, and one entry at least.
Other rows are left out; a null vec_id is kept, and repeated rows each get their own result. Vectors of different
lengths are whitened apart, each length with its own n, sums and components. Components without deviation (beyond the
rank, or where a length has one distinct vector only) do not exist, so fewer than `most` may be returned, none for an
empty table. deviation is null where it does not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import cut

SCALE, MOST = 256, 4
#: Rows that a task folds into its R at once, and how many R's meet in a node of the tree.
BLOCK_ROWS, FAN_IN = 2048, 16
#: Sweeps of rotations at most, and the cosine between two columns that counts as none.
SWEEPS, ORTHOGONAL = 60, 1e-15
#: Components with less than this part of the trace are rounding, not deviation.
LEAST_PART = 1e-24


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of rows = QR; a square, padded by zeros where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.pad(r, ((0, rows.shape[1] - len(r)), (0, 0)))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by rotating pairs of r's columns.

    In each step of a sweep all columns are paired off, so a step's rotations do not touch each other.
    """
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :d] = r
    order = np.arange(even)
    for _ in range(SWEEPS):
        most = 0.0
        for _ in range(even - 1):
            p, q = order[: even // 2], order[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx) * np.sqrt(yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            turn = off > ORTHOGONAL
            most = max(most, float(off.max(initial=0)))
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            tangent = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, tangent)
            sin = cos * tangent
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * left - sin * right, sin * left + cos * right
            order = np.concatenate([order[:1], np.roll(order[1:], 1)])
        if most <= 1e-14:
            break
    found = np.linalg.norm(a[:, :d], axis=0)
    by = np.argsort(-found, kind="stable")
    return found[by], v[:d, :d][:, by]


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension of one length's fit list."""

    def part(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column("x"))
                n += len(x)
                # 32-bit halves cannot overflow in a batch; Python's integers hold the rest
                low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                now = [int(h) * 2**32 + int(w) for h, w in zip(high, low, strict=True)]
                total = now if total is None else [a + c for a, c in zip(total, now, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * len(total), pa.int64())], ["dim", "s", "n"])

    found = fit.select("x").mapInArrow(part, "dim int, s string, n long")
    rows = found.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row a dimension
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def compressed(fit: DataFrame, centre: np.ndarray, block: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> np.ndarray:
    """R of one length's centred fit list."""
    d = len(centre)

    def fold(batches):
        r, node = np.zeros((0, d)), None
        for b in batches:
            if b.num_rows and node is None:
                node = b.column("node")[0].as_py()
            x = rows_of(b.column("x")).astype(np.float64) - centre if b.num_rows else np.zeros((0, d))
            for at in range(0, len(x), block):
                r = triangle(np.vstack([r, x[at : at + block]]))
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["node", "r"])

    def join(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for row in table.sort_by("node").column("r").combine_chunks():
            r = triangle(np.vstack([r, np.asarray(row.values).reshape(d, d)]))
        return pa.table([pa.array([table.column("up")[0].as_py()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["node", "r"])

    level = cut(fit.select(F.spark_partition_id().cast("long").alias("node"), "x").mapInArrow(fold, "node long, r array<double>"))
    while (nodes := level.count()) > 1:
        # nodes are numbered by partition, so a node of the next level has fan_in of them at most; the number falls each time
        level = cut(level.withColumn("up", F.floor(F.col("node") / fan_in).cast("long")).groupBy("up").applyInArrow(join, "node long, r array<double>"))
    return np.asarray(level.first().r).reshape(d, d) if nodes else np.zeros((d, d))


def fitted(fit: DataFrame, most: int = MOST) -> dict:
    """n, sums, centre, components (columns), deviations and explained parts of one length's fit list."""
    n, s = sums(fit)
    centre = np.array([a / n for a in s])
    r = compressed(fit, centre)
    values, vectors = jacobi(r)
    trace = float((values**2).sum()) / n
    kept = [k for k in range(min(most, len(values))) if values[k] ** 2 / n > LEAST_PART * trace]
    vectors = vectors[:, kept]
    for k in range(vectors.shape[1]):  # the sign is free; the largest entry is positive
        vectors[:, k] *= 1.0 if vectors[np.abs(vectors[:, k]).argmax(), k] >= 0 else -1.0
    deviation = values[kept] / np.sqrt(n)
    return {"n": n, "sums": s, "centre": centre, "components": vectors, "deviations": deviation, "explained": deviation**2 / trace if trace else deviation}


def identity_error(fit: DataFrame, model: dict) -> float:
    """Largest entry, by size, of the whitened fit list's covariance minus the identity."""
    centre, turn, n = model["centre"], model["components"] / model["deviations"], model["n"]
    k = turn.shape[1]

    def part(batches):
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if not b.num_rows:
                continue
            w = (rows_of(b.column("x")).astype(np.float64) - centre) @ turn
            m, own = len(w), w.mean(0)
            step = own - mean
            spread += (w - own).T @ (w - own) + np.outer(step, step) * count * m / (count + m)
            mean, count = mean + step * m / (count + m), count + m
        if count:
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, np.full(k * k, count), mean[i], mean[j], spread.ravel())], ["i", "j", "m", "a", "b", "s"])

    parts = cut(fit.select("x").mapInArrow(part, "i long, j long, m long, a double, b double, s double"))
    means = parts.groupBy("i", "j").agg((F.sum(F.col("m") * F.col("a")) / n).alias("ma"), (F.sum(F.col("m") * F.col("b")) / n).alias("mb"))
    spread = F.col("s") + F.col("m") * (F.col("a") - F.col("ma")) * (F.col("b") - F.col("mb"))
    cov = parts.join(means, ["i", "j"]).groupBy("i", "j").agg((F.sum(spread) / n).alias("c"))
    return cov.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def exact_deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exactly; None where it does not fit 64 bits."""
    top = max([abs(n * int(x.max(initial=0))), abs(n * int(x.min(initial=0)))]) + max(map(abs, s))
    if top * top * x.shape[1] < 2**63:
        return ((n * x - np.array(s, np.int64)) ** 2).sum(1).tolist()
    out = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    return [a if a < 2**63 else None for a in out]


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the sound rows, with their number of dimensions d."""
    top = float(2**63)
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < top)) & (F.size(vector) > 0)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, x).alias("x"))
    return held.where("x IS NOT NULL").withColumn("d", F.size("x"))


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every sound row."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    given = scaled(vectors, vector)
    fit = cut(given.select("d", "x").distinct())
    out = vectors.sparkSession.createDataFrame([], schema)
    for size in sorted(r.d for r in fit.select("d").distinct().collect()):  # a row a length
        own = fit.where(F.col("d") == size)
        model = fitted(own, most)
        if not len(model["deviations"]):
            continue
        error = identity_error(own, model)
        out = out.unionByName(given.where(F.col("d") == size).select("vec_id", "x").mapInArrow(_projected(model, error), schema))
    return out


def _projected(model: dict, error: float):
    centre, turn, n, s, explained = model["centre"], model["components"] / model["deviations"], model["n"], model["sums"], model["explained"]
    k = turn.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b.column("x"))
            w = (x.astype(np.float64) - centre) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array(exact_deviation(x, n, s), pa.int64()).take(at),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run
