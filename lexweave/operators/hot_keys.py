"""Per-key results where a few keys hold most records.

States are merged along a tree. A chunk is what one task reads: a file split or a shuffle partition, whose size Spark's settings
fix. Every chunk is combined where it lies; then the partial states of at most ``fan_in`` chunks meet in one reducer, then those of
``fan_in`` reducers, and so on until one state a key is left. No reducer ever receives more than ``fan_in`` states of a key, however
many rows the key has. States that grow with the key (sets of documents) are cut into blocks of the id range, so a state has a
fixed largest size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import input_tasks, valid_ids

SLOT = "_tree_slot"


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    leaf: Mapping[str, Column],
    merge: Mapping[str, Callable[[Column], Column]],
    fan_in: int = 4,
    chunks: int | None = None,
) -> DataFrame:
    """One row a key with the merged states; null keys form a group of their own.

    ``leaf``: state name -> aggregate over input rows. ``merge``: state name -> aggregate over partial states; it has to be
    associative and commutative. ``chunks``: at most how many tasks read the input (default: found from its plan); the tree has
    log(chunks) / log(fan_in) rounds, rounded up. An empty input gives no rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in has to be at least 2")
    if set(leaf) != set(merge):
        raise ValueError("leaf and merge need the same states")
    slots = -(-(chunks or input_tasks(df)) // fan_in)
    slot = F.lit(0) if slots == 1 else F.floor(F.spark_partition_id() / F.lit(fan_in)).cast("int")
    level = df.groupBy(*keys, slot.alias(SLOT)).agg(*[a.alias(n) for n, a in leaf.items()])
    while slots > 1:
        slots = -(-slots // fan_in)
        to = F.lit(0) if slots == 1 else F.floor(F.col(SLOT) / F.lit(fan_in)).cast("int")  # a last round for all that is left
        level = level.groupBy(*keys, to.alias(SLOT)).agg(*[merge[n](F.col(n)).alias(n) for n in leaf])
    return level.drop(SLOT)


def distinct_lines(rows: DataFrame) -> DataFrame:
    """``term, n_valid`` of each line once.

    A redelivered row (same ``line_id`` and term) counts once. A row without ``line_id`` is told apart by its content.
    Only key and count travel, not the id lists.
    """
    content = F.when(F.col("line_id").isNull(), F.xxhash64("shard", "term", "idxs", "written_at"))
    return (
        rows.select("line_id", "term", content.alias("_content"), F.size(valid_ids(F.col("idxs"))).cast("bigint").alias("n_valid"))
        .groupBy("line_id", "term", "_content")
        .agg(F.max("n_valid").alias("n_valid"))
        .select("term", "n_valid")
    )


def term_loads(rows: DataFrame, fan_in: int = 4) -> DataFrame:
    """``term, n_rows, n_entries`` over all rows (the null and the empty term included), by tree aggregation."""
    return tree_aggregate(
        distinct_lines(rows),
        ["term"],
        {"n_rows": F.count(F.lit(1)), "n_entries": F.sum("n_valid")},
        {"n_rows": F.sum, "n_entries": F.sum},
        fan_in,
    )


def hot_terms(rows: DataFrame, per_mille: int = 20, fan_in: int = 4) -> DataFrame:
    """``term, kind, n, total``: terms with at least ``per_mille`` thousandths of all rows ('rows') or of all valid entries ('entries').

    Rows with a null or empty term count in the totals but are never named. At most 1000/per_mille terms of a kind can qualify.
    """
    loads = term_loads(rows, fan_in)
    # one scalar subquery over the same tree: its exchanges are reused, not computed again
    total = loads.agg(F.struct(F.sum("n_rows").alias("r"), F.sum("n_entries").alias("e")).alias("t")).scalar()
    both = loads.filter(F.col("term").isNotNull() & (F.col("term") != "")).select(
        "term",
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("kind"), F.col("n_rows").alias("n"), total.getField("r").alias("total")),
                F.struct(F.lit("entries").alias("kind"), F.col("n_entries").alias("n"), total.getField("e").alias("total")),
            )
        ).alias("x"),
    )
    return both.select("term", "x.kind", "x.n", "x.total").filter((F.col("n") > 0) & (F.col("n") * 1000 >= F.col("total") * per_mille))


def term_documents(rows: DataFrame, block_bits: int = 14, fan_in: int = 4) -> DataFrame:
    """``term, block, docs``: the documents of every term, each valid id once, ascending, in blocks of 2**block_bits ids.

    A term's blocks are separate groups of the tree, so that a term that occurs in all documents is spread over many tasks and
    no state exceeds 2**block_bits ids. Terms without a valid id have one row with a null block and no documents. Null and
    empty terms are left out. Redelivery and repeated ids don't matter here: a set takes an id once.
    """
    named = rows.filter(F.col("term").isNotNull() & (F.col("term") != "")).select("term", F.array_distinct(valid_ids(F.col("idxs"))).alias("ids"))
    pairs = named.select("term", F.explode("ids").alias("doc")).withColumn("block", F.shiftright("doc", block_bits))
    sets = tree_aggregate(
        pairs,
        ["term", "block"],
        {"docs": F.collect_set("doc")},
        {"docs": lambda c: F.array_distinct(F.flatten(F.collect_list(c)))},
        fan_in,
    ).select("term", "block", F.array_sort("docs").alias("docs"))
    # terms without a document are found by a tree of its own, over flags: no list is ever grouped by term alone
    some = tree_aggregate(named.select("term", (F.size("ids") > 0).alias("some")), ["term"], {"some": F.bool_or("some")}, {"some": F.bool_or}, fan_in)
    bare = some.filter(~F.col("some")).select("term", F.lit(None).cast("bigint").alias("block"), F.array().cast("array<bigint>").alias("docs"))
    return sets.unionAll(bare)
