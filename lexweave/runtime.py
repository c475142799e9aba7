"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest value of an unsigned 32-bit document id.
MAX_ID = 4294967295


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory (a Parquet file or a directory of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder that goes with the
    process; anywhere else executors don't share such a folder: RuntimeError."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later jobs neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for tables that are read again."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{root.get() if root.isDefined() else spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_tasks(df: DataFrame) -> int:
    """At most how many tasks ``df`` is computed by: the splits of its scans, or the shuffle width where it comes from a shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # its tasks aren't known before it runs, but its shuffles have this width
        return shuffle_width(df.sparkSession)
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


@dataclass(frozen=True)
class Pinned:
    """A table computed once, and whether it is small enough to be broadcast."""

    df: DataFrame
    few: bool

    def select(self, *columns) -> Pinned:
        """Distinct rows of some columns."""
        return Pinned(self.df.select(*columns).distinct(), self.few)


def pinned(df: DataFrame, rows: int = 500_000, stored: bool = False) -> Pinned:
    """``df`` written to the shared checkpoint folder (unless it is ``stored`` already) and its rows counted there; ``rows``: up to how
    many are few. They should be narrow."""
    kept = df if stored else cut(df)
    return Pinned(kept, kept.count() <= rows)


def lookup_join(big: DataFrame, small: DataFrame | Pinned, keys: list[str], how: str = "inner", rows: int = 500_000, salts: int = 32) -> DataFrame:
    """``big`` joined with ``small``, whose rows are counted first: up to ``rows`` of them are broadcast.

    More are joined by ``keys`` and a salt: each row of ``small`` goes to ``salts`` places, each row of ``big`` to one of them, so
    that a key that holds most rows of ``big`` is spread. ``how``: inner, left, left_semi or left_anti. ``small`` is computed once.
    """
    side = small if isinstance(small, Pinned) else pinned(small, rows)
    if side.few:
        return big.join(F.broadcast(side.df), keys, how)
    salt = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(salts)).cast("int")
    spread = side.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread, [*keys, "_salt"], how).drop("_salt")


def is_valid_id(c: Column) -> Column:
    """True for a document id that fits 32 unsigned bits, else false (null included)."""
    return F.coalesce((c >= 0) & (c <= MAX_ID), F.lit(False))


def valid_ids(c: Column) -> Column:
    """The valid ids of an array column; an empty array for null."""
    return F.filter(F.coalesce(c, F.array().cast("array<bigint>")), is_valid_id)
