"""Spherical k-means with deterministic seeds over ``row_id, embedding`` rows.

A step is one pass: the k centroids (k * d numbers, of checked size) are broadcast; each task multiplies its rows with them, a bounded
number of products at a time, and hands out the sums of the clusters that it met; the sums of all tasks are added by the engine, and
only k * d numbers come back to the driver. Rows can be scaled to length 1 in the pass (``unit``), so nothing has to be kept between
the steps. Rows whose embedding is null or of another length than the centroids belong to no cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import lookup_join
from .features import number_ids

#: Largest k * d: what the driver holds, broadcasts and collects (64 MB of numbers).
MAX_CENTROIDS = 1 << 23
#: Products of rows and centroids that a task holds at a time (128 MB), and centroids of a block.
PRODUCTS, BLOCK = 1 << 24, 1 << 16
#: Sums that a task holds before it hands them out.
SUMS = 1 << 22


def normalize(points: DataFrame) -> DataFrame:
    """``points`` with embeddings of length 1, as DOUBLE; zero vectors stay."""
    return points.withColumn("embedding", vectors.unit(F.col("embedding")))


def default_k(points: DataFrame) -> int:
    return math.isqrt(points.count())


def step_sample(points: DataFrame, k: int, strict: bool = True, parts: int | None = None) -> DataFrame:
    """``cluster, centroid``: every (rows // k)-th row in the order of ``row_id``, the first k of them.

    ValueError for k < 1, and for k > rows unless ``strict`` is off: then the first row is taken k times.
    """
    n = points.count()
    if k < 1 or (k > n and strict) or not n:
        raise ValueError(f"can't take {k} seeds of {n} rows")
    if k > n:
        first = points.orderBy("row_id").limit(1)
        return first.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("cluster"), F.col("embedding").alias("centroid"))
    step = n // k
    place = number_ids(points, "row_id", parts).filter(((F.col("dim") - 1) % step == 0) & (F.floor((F.col("dim") - 1) / step) < k))
    return lookup_join(points, place, ["row_id"]).select(F.floor((F.col("dim") - 1) / step).cast("bigint").alias("cluster"), F.col("embedding").alias("centroid"))


def as_matrix(centroids: DataFrame, unit: bool = False) -> np.ndarray:
    """``cluster, centroid`` rows as a matrix, its rows scaled to length 1 with ``unit``."""
    rows = centroids.orderBy("cluster").select("centroid").limit(MAX_CENTROIDS + 1).collect()
    m = checked(np.array([r[0] for r in rows], np.float64))
    return scaled(m) if unit else m


def checked(m: np.ndarray) -> np.ndarray:
    if m.size > MAX_CENTROIDS:
        raise ValueError(f"k * dimensions must not exceed {MAX_CENTROIDS}, as centroids are broadcast")
    return m


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=x.copy(), where=length > 0)


def as_centroids(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "cluster bigint, centroid array<double>")


def _vectors(column: pa.Array, unit: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return scaled(x) if unit else x


def _labels(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Index of the first largest product; NaN never wins."""
    out = np.zeros(len(x), np.int64)
    rows = max(1, PRODUCTS // min(len(m), BLOCK))
    for a in range(0, len(x), rows):
        best = None
        for c in range(0, len(m), BLOCK):
            p = np.nan_to_num(x[a : a + rows] @ m[c : c + BLOCK].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            at = p.argmax(axis=1)
            top = p[np.arange(len(p)), at]
            better = np.ones(len(p), bool) if best is None else top > best
            best = top if best is None else np.maximum(best, top)
            out[a : a + rows][better] = at[better] + c
    return out


def _usable(points: DataFrame, d: int) -> DataFrame:
    return points.filter(F.size("embedding") == d)  # null has no size


def assign(points: DataFrame, m: np.ndarray, unit: bool = False) -> DataFrame:
    """``row_id, cluster`` by the largest product with a centroid (of equal ones the first)."""
    shared = points.sparkSession.sparkContext.broadcast(checked(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_labels(_vectors(b.column(1), unit), shared.value))], names=["row_id", "cluster"])

    kind = dict(points.dtypes)["row_id"]
    return _usable(points, m.shape[1]).select("row_id", "embedding").mapInArrow(run, f"row_id {kind}, cluster bigint")


def step(points: DataFrame, m: np.ndarray, unit: bool = False) -> np.ndarray:
    """The new centroids: sums of the assigned rows scaled to length 1; an empty cluster is the zero vector."""
    k, d = m.shape
    shared = points.sparkSession.sparkContext.broadcast(checked(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def handed_out() -> pa.RecordBatch:
            c = np.array(list(sums), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(c, d)), pa.array(np.tile(np.arange(d), len(c))), pa.array(np.concatenate(list(sums.values())))], names=["c", "j", "s"])

        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(0), unit)
            label = _labels(x, shared.value)
            order = np.argsort(label, kind="stable")
            met, first = np.unique(label[order], return_index=True)
            for c, s in zip(met.tolist(), np.add.reduceat(x[order], first, axis=0)):
                sums[c] = sums[c] + s if c in sums else s
            if len(sums) * d > SUMS:
                yield handed_out()
                sums = {}
        if sums:
            yield handed_out()

    added = _usable(points, d).select("embedding").mapInArrow(run, "c bigint, j bigint, s double").groupBy("c", "j").agg(F.sum("s").alias("s")).toArrow()
    shared.destroy()
    total = np.zeros((k, d))
    total[added.column("c").to_numpy(), added.column("j").to_numpy()] = added.column("s").to_numpy()
    return scaled(total)


def shift_stats(old: np.ndarray, new: np.ndarray) -> dict[str, float]:
    """Largest, mean and sample standard deviation of the distances that the centroids moved (0 for a single one)."""
    moved = np.sqrt(((old - new) ** 2).sum(axis=1))
    return {"max": float(moved.max()), "mean": float(moved.mean()), "stddev": float(moved.std(ddof=1)) if len(moved) > 1 else 0.0}


def converged(old: np.ndarray, new: np.ndarray, epsilon: float) -> bool:
    """Whether no component moved by more than ``epsilon``."""
    return bool((np.abs(old - new) <= epsilon).all())


@dataclass
class Clustering:
    centroids: np.ndarray
    steps: int
    shifts: list[dict[str, float]]


def kmeans(
    points: DataFrame, k: int | None = None, epsilon: float = 0.05, max_iter: int = 25, verbose: bool = False, seeds: np.ndarray | None = None, unit: bool = False
) -> Clustering:
    """Steps from the seeds (default: ``step_sample``) until none moves by more than ``epsilon``, at most ``max_iter``; the last new centroids.

    ``points`` should be normalised, or ``unit`` set. They are read anew in each step: store what is dear to compute. ``k`` defaults
    to the square root of the number of rows.
    """
    if max_iter < 0 or epsilon < 0:
        raise ValueError("max_iter and epsilon must not be negative")
    points = points.select("row_id", "embedding")
    m = as_matrix(step_sample(points, default_k(points) if k is None else k), unit) if seeds is None else seeds
    shifts: list[dict[str, float]] = []
    for i in range(max_iter):
        new = step(points, m, unit)
        shifts.append(shift_stats(m, new))
        done = converged(m, new, epsilon)
        m = new
        if verbose:
            print(f"step {i + 1}: {shifts[-1]}")
        if done:
            break
    return Clustering(m, len(shifts), shifts)


def word_clusters(points: DataFrame, k: int | None = None, epsilon: float = 0.05, max_iter: int = 25) -> DataFrame:
    """``row_id, cluster`` of ``points``, scaled to length 1, after ``kmeans``."""
    return assign(points, kmeans(points, k, epsilon, max_iter, unit=True).centroids, unit=True)
