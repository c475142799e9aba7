"""Conjunctive keyword queries over a boolean index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import lookup_join, pinned


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, n_terms``: the distinct words of each query and their number. A blank or null query has none; rows with the
    same ``query_id`` are one query with the words of all."""
    each = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("query")))).alias("term")).groupBy("query_id").agg(F.collect_set("term").alias("w"))
    return each.select("query_id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))


def bool_and(postings: DataFrame, queries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``query_id, doc[, title]``: the documents with all words of a query.

    ``postings``: ``term, doc`` or ``term, docs`` (array). Words compare exactly and may repeat. With an unknown word a query has no
    documents. ``titles``: ``doc, title``; a document without one has ''.

    The postings are reduced to the words of the queries first, where they are read (``lookup_join``: the words are broadcast if they
    are few); only these postings are shuffled, by term and document, then by query and document, so a frequent term is spread.
    """
    sought = pinned(query_terms(queries))
    hit = lookup_join(postings, sought.select("term"), ["term"], "left_semi")
    flat = (hit.select("term", F.explode("docs").alias("doc")) if "docs" in postings.columns else hit.select("term", "doc")).distinct()
    hits = lookup_join(flat, sought, ["term"]).groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("n"), F.max("n_terms").alias("n_terms"))
    found = hits.filter(F.col("n") == F.col("n_terms")).select("query_id", "doc")
    if titles is None:
        return found
    return found.join(titles.select("doc", "title"), "doc", "left").select("query_id", "doc", F.coalesce("title", F.lit("")).alias("title"))


def in_order(found: DataFrame) -> DataFrame:
    """``found`` with ``pos``: the place from 1 of each document of a query, ascending by ``doc``; one task a query, for results to be shown."""
    return found.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("doc")).cast("bigint"))


def bool_status(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, status``: 'empty' for a blank query, 'no_match' if a word is no term of the index, else 'ok' (perhaps without documents)."""
    sought = pinned(query_terms(queries))
    known = lookup_join(terms.select("term"), sought.select("term"), ["term"], "left_semi").distinct().withColumn("_known", F.lit(1))
    per_query = sought.df.join(known, "term", "left").groupBy("query_id").agg((F.count("_known") == F.count(F.lit(1))).alias("all_known"))
    status = F.when(F.col("all_known").isNull(), "empty").when(F.col("all_known"), "ok").otherwise("no_match")
    return queries.select("query_id").distinct().join(per_query, "query_id", "left").select("query_id", status.alias("status"))
