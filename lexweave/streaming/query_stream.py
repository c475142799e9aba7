"""Query streams against a fixed index: each micro-batch of ``query_id, query`` is answered like a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``query_id, query`` from the lines of new files in a directory: every line is a query, also one that comes again.

    The id is made from the file and the place of the line in it, so it is the same when a batch is repeated. A file is read as a whole.
    """
    files = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # what follows the last line feed is a line only if it holds something
    each = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "query"))
    return each.select(F.xxhash64("file", "at").alias("query_id"), "query")


def answer(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``operator`` (queries -> answers, any batch operator, ranking windows included) on each micro-batch and give the answers to
    ``sink`` (answers, batch id). A batch may come again after a failure, with the same id: the sink should overwrite by it."""
    writer = stream.writeStream.foreachBatch(lambda batch, i: sink(operator(batch), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_and(stream: DataFrame, postings: DataFrame, term_col: str = "term") -> DataFrame:
    """A stream of ``query_id, doc`` for one-word queries: a stream-static join without state."""
    return stream.select("query_id", F.trim("query").alias(term_col)).join(postings.select(term_col, "doc"), term_col).select("query_id", "doc")
