"""Vectors with holes as keyed rows ``i, e``: an absent row is a hole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(vec: DataFrame, new: DataFrame) -> DataFrame:
    """``vec`` with the elements of ``new``, which replace those at the same places; of several for a place the largest."""
    both = vec.select("i", "e", F.lit(0).alias("_t")).unionAll(new.select("i", "e", F.lit(1).alias("_t")))
    return both.groupBy("i").agg(F.max_by("e", F.struct("_t", "e")).alias("e"))


def remove(vec: DataFrame, places: DataFrame) -> DataFrame:
    return vec.join(places.select("i").distinct(), "i", "left_anti").select("i", "e")


def get(vec: DataFrame, places: DataFrame) -> DataFrame:
    """``i, e`` for each place; null at a hole."""
    return places.select("i").join(vec.select("i", "e"), "i", "left")


def update(vec: DataFrame, places: DataFrame, change: Callable[[Column], Column], default) -> DataFrame:
    """``vec`` with ``change`` applied at the places; a hole there takes ``default`` unchanged."""
    at = places.select("i").distinct().withColumn("_at", F.lit(True))
    e = F.when(F.col("_at").isNull(), F.col("e")).when(F.col("_is"), change(F.col("e"))).otherwise(F.lit(default))
    return vec.select("i", "e", F.lit(True).alias("_is")).join(at, "i", "full").select("i", e.alias("e"))


def update_all(vec: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return vec.select("i", change(F.col("e")).alias("e"))


def length(vec: DataFrame) -> DataFrame:
    """One row ``len, dim``: the elements, and the last place plus one."""
    return vec.agg(F.count(F.lit(1)).alias("len"), F.coalesce(F.max("i") + 1, F.lit(0)).alias("dim"))


def sparse_dim(vec: DataFrame) -> DataFrame:
    """One row ``dim``: the last place of a sparse vector, 0 for an empty one."""
    return vec.agg(F.coalesce(F.max("i"), F.lit(0)).alias("dim"))
