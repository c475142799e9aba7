"""Ranked retrieval: tf-idf vectors, cosine similarity, the best documents of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stemming, text, weighting
from ..runtime import Pinned, lookup_join, pinned
from .index import TfIndex


def analysed(queries: DataFrame, stemmer: str = "none") -> DataFrame:
    """``query_id, pos, term``: the lower-case, stemmed words of each query in order, repeats kept."""
    weighting.choose(stemming.STEMMERS, stemmer, "stemmer")
    each = queries.select("query_id", F.posexplode(text.words(F.lower("query"))).alias("pos", "term"))
    return each if stemmer == "none" else each.withColumn("term", stemming.stem(F.col("term"), stemmer))


def query_idf(index: TfIndex, queries: DataFrame, stemmer: str = "none") -> DataFrame:
    """``query_id, pos, term, idf`` of every query word; an unknown word has 0, a term without documents an infinite one."""
    words = pinned(analysed(queries, stemmer))
    joined = words.df.join(index.of(words.select("term"))[1], "term", "left").withColumn("_n", index.n_docs)
    value = F.when(F.col("df") == 0, F.lit(float("inf"))).otherwise(F.coalesce(weighting.idf(F.col("_n"), F.col("df")), F.lit(0.0)))
    return joined.select("query_id", "pos", "term", value.alias("idf"))


def similarities(index: TfIndex, queries: DataFrame, tf: str = "identity", stemmer: str = "none", norms: DataFrame | None = None) -> DataFrame:
    """``query_id, doc, sim`` of every document with a word of the query.

    sim = sum of (idf w(qtf))(idf w(tf)) over the query's terms / (norm of the query * norm of the document). Where that is 0/0 or a
    query holds a term without documents, sim is 0; a positive sum over a zero norm is infinite. Rows with the same ``query_id`` are
    one query with the words of all.
    """
    weight = weighting.choose(weighting.TF, tf, "weighting")
    norms = index.norms(tf) if norms is None else norms
    words = pinned(analysed(queries, stemmer).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    postings, stats = index.of(words.select("term"))
    known = words.df.join(stats, "term", "left").withColumn("_n", index.n_docs)
    idf = F.coalesce(weighting.idf(F.col("_n"), F.col("df")), F.lit(0.0))
    vector = known.select("query_id", "term", idf.alias("idf"), (idf * weight(F.col("qtf"))).alias("q"), F.coalesce(F.col("df") == 0, F.lit(False)).alias("hollow"))
    few = words.few  # so are the vectors and their lengths
    lengths = vector.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"), F.max("hollow").alias("hollow"))
    hits = lookup_join(postings, Pinned(vector.drop("hollow"), few), ["term"])
    dots = hits.groupBy("query_id", "doc").agg(F.sum(F.col("q") * F.col("idf") * weight(F.col("tf"))).alias("dot"))
    scored = lookup_join(dots, Pinned(lengths, few), ["query_id"]).join(norms, "doc", "left")
    den = F.col("q_norm") * F.coalesce("norm", F.lit(0.0))
    sim = (
        F.when(F.col("hollow"), 0.0)
        .when((den == 0) & (F.col("dot") == 0), 0.0)
        .when(den == 0, F.lit(float("inf")))
        .otherwise(F.nanvl(F.col("dot") / F.when(den != 0, den), F.lit(0.0)))
    )
    return scored.select("query_id", "doc", sim.alias("sim"))


def rank(
    index: TfIndex,
    queries: DataFrame,
    tf: str = "identity",
    stemmer: str = "none",
    k: int = 5,
    titles: DataFrame | None = None,
    norms: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """``query_id, rank, doc, sim[, title]``: the ``k`` most similar documents of each query; of equal ones the larger id first.

    ``digits``: round similarities before ranking, so that summation order can't swap equal ones. Titles are joined after the cut.
    """
    sims = similarities(index, queries, tf, stemmer, norms)
    if digits is not None:
        sims = sims.withColumn("sim", F.round("sim", digits))
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), F.desc("doc"))
    best = sims.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    if titles is None:
        return best.select("query_id", "rank", "doc", "sim")
    return best.join(titles.select("doc", "title"), "doc", "left").select("query_id", "rank", "doc", "sim", F.coalesce("title", F.lit("")).alias("title"))
