"""Usable embedding rows: their vectors as they are or as unit vectors, each distinct vector once or a few times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import lookup_join, pinned

DIM = 128
#: More than the cosine of two unit vectors can change when both are kept in half precision.
ROUNDING = 5e-4


def usable(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row ids, unit vectors) of the rows with an id and a vector of 128 finite numbers that aren't all zero."""
    return _usable(ids, lists)[:2]


def _usable(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``usable``, and the vectors as they are."""
    n = np.asarray(lists.value_lengths().fill_null(0))
    keep = np.flatnonzero((n == DIM) & np.asarray(ids.is_valid()))
    flat = lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
    units = directed(flat)
    good = np.isfinite(units).all(axis=1)
    return ids.take(pa.array(keep[good])).to_numpy(zero_copy_only=False).astype(np.int64), units[good], flat[good]


def directed(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` at length 1; not finite where a row has no direction."""
    # scaled first, so that squares of very large or small numbers stay in range
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unpack(column) -> np.ndarray:
    """Unit vectors (float32) of packed ones."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    x = np.concatenate([np.frombuffer(b"".join(p.to_pylist()), np.float16) for p in parts] or [np.zeros(0, np.float16)]).reshape(-1, DIM).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def full_rows(rows: DataFrame) -> DataFrame:
    """``row_id, vec`` (the 128 numbers as they are, in single precision where the table holds them so, else in double) of the usable
    rows of ``row_id, embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, x = _usable(b.column(0), b.column(1))
            x = (x + 0.0).astype(np.float32 if b.column(1).type.value_type == pa.float32() else np.float64)  # -0 is 0
            packed, size = x.tobytes(), x.itemsize * DIM
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([packed[i : i + size] for i in range(0, len(packed), size)], pa.binary())], names=["row_id", "vec"])

    return rows.select("row_id", "embedding").mapInArrow(run, "row_id bigint, vec binary")


def full(column) -> np.ndarray:
    """The vectors that ``full_rows`` packed."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64 if values and len(values[0]) == 8 * DIM else np.float32).reshape(-1, DIM)


def half_rows(packed: DataFrame) -> DataFrame:
    """``row_id, vec`` (unit vectors of 128 half-precision numbers) of the rows of ``full_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = directed(full(b.column(1)).astype(np.float64)).astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([units[i : i + 2 * DIM] for i in range(0, len(units), 2 * DIM)], pa.binary())], names=["row_id", "vec"])

    return packed.select("row_id", "vec").mapInArrow(run, "row_id bigint, vec binary")


def turned_rows(packed: DataFrame) -> DataFrame:
    """``row_id, vec`` (128 signed bytes in the direction of the vector, which is turned by a fixed rotation) of the rows of ``full_rows``.

    Cosines stay as they are. After the rotation no vector has a component that stands out, so the bytes are fine enough for each;
    rounding is independent from component to component.
    """
    turn = np.linalg.qr(np.random.default_rng(20240307).standard_normal((DIM, DIM)))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = directed(full(b.column(1)).astype(np.float64)) @ turn
            units = np.rint(x / np.abs(x).max(axis=1, initial=1e-30, keepdims=True) * 127).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([units[i : i + DIM] for i in range(0, len(units), DIM)], pa.binary())], names=["row_id", "vec"])

    return packed.select("row_id", "vec").mapInArrow(run, "row_id bigint, vec binary")


def float_rows(rows: DataFrame) -> DataFrame:
    """``row_id, vec`` (128 single-precision numbers) of the usable rows of ``row_id, embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable(b.column(0), b.column(1))
            packed = np.ascontiguousarray(x.astype(np.float32)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([packed[i : i + 4 * DIM] for i in range(0, len(packed), 4 * DIM)], pa.binary())], names=["row_id", "vec"])

    return rows.select("row_id", "embedding").mapInArrow(run, "row_id bigint, vec binary")


def first_copies(units: DataFrame, keep: int) -> DataFrame:
    """The rows with the ``keep`` smallest row ids of each distinct vector.

    However many copies a vector has, every task passes on at most ``keep`` ids of it, so no task meets them all.
    """
    rank = F.dense_rank().over(W.partitionBy("vec").orderBy("row_id"))
    return units.withColumn("_r", rank).filter(F.col("_r") <= keep).select("row_id", "vec").dropDuplicates(["vec", "row_id"])


def first_rows(rows: DataFrame, keep: int) -> DataFrame:
    """``first_copies`` of the ``full_rows`` of ``row_id, embedding``; only vectors whose hash occurs again are shuffled."""
    packed = full_rows(rows).withColumn("_h", F.xxhash64("vec"))
    again = pinned(packed.groupBy("_h").count().filter("count > 1").select("_h"), 2_000_000)
    alone, copies = (lookup_join(packed, again, ["_h"], how).select("row_id", "vec") for how in ("left_anti", "left_semi"))
    return alone.unionByName(first_copies(copies, keep))
