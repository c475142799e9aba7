"""Writers of the text formats; a directory of part files each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import libsvm_lines


def bool_index_lines(index: DataFrame) -> DataFrame:
    """``value``: ``term TAB id id ...`` of ``term, docs``."""
    ids = F.array_join(F.transform("docs", lambda x: x.cast("string")), " ")
    return index.select(F.concat_ws("\t", F.col("term"), ids).alias("value"))


def tf_index_lines(index: DataFrame) -> DataFrame:
    """``value``: ``term TAB doc tf doc tf ...`` of ``term, postings``."""
    cells = F.transform("postings", lambda p: F.concat_ws(" ", p["doc"].cast("string"), p["tf"].cast("string")))
    return index.select(F.concat_ws("\t", F.col("term"), F.array_join(cells, " ")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("lineSep", "\n").text(path)


def write_bool_index(index: DataFrame, path: str) -> None:
    write_lines(bool_index_lines(index), path)


def write_tf_index(index: DataFrame, path: str) -> None:
    write_lines(tf_index_lines(index), path)


def write_libsvm(features: DataFrame, path: str) -> None:
    write_lines(libsvm_lines(features).select(F.col("line").alias("value")), path)


def cluster_lines(assigned: DataFrame) -> DataFrame:
    """``value``: ``word TAB cluster`` of ``word, cluster``; words are written as they are."""
    return assigned.select(F.concat_ws("\t", "word", F.col("cluster").cast("string")).alias("value"))


def write_clusters(assigned: DataFrame, path: str) -> None:
    write_lines(cluster_lines(assigned), path)
