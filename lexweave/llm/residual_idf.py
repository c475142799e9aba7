"""How distinctive a term is for a document of its run: tf * idf, and tf * residual idf.

The residual of a term is its observed ``ln(N / df)`` minus what a Poisson spread of its ``cf`` occurrences over the N documents
would give, ``-ln(1 - exp(-cf / N))``. A term scattered at random has a residual near zero however rare it is; a term
concentrated in few documents has a large one. The residual times the term's frequency in the document is its ``score``.

The postings are shuffled once by (run, term) to find the row that holds, and once by (run, document) for the norms. No list is
ever grouped by run, so a run with most documents is as spread as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import lookup_join


def current_rows(index: DataFrame) -> DataFrame:
    """For each (``index_id``, ``term``) the row with the latest ``built_at``, with the run's largest ``doc_count`` as ``n_docs``.

    A null ``built_at`` is the earliest. Rows built at the same time are told apart by ``loaded_at`` (the latest holds), then by
    content, so that the choice doesn't depend on row order. Rows without run or term belong to no document and are left out.
    """
    rows = index.filter(F.col("index_id").isNotNull() & F.col("term").isNotNull()).select(
        "index_id", "term", "inv_idx", "doc_count", "built_at", "loaded_at"
    )
    latest = W.partitionBy("index_id", "term").orderBy(
        F.desc_nulls_last("built_at"), F.desc_nulls_last("loaded_at"), F.xxhash64("inv_idx", "doc_count")
    )
    held = rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1")
    # one row a run; the lists stay where they are, or are spread by a salt where there are too many runs to broadcast
    sizes = rows.groupBy("index_id").agg(F.max("doc_count").alias("n_docs"))
    return lookup_join(held.select("index_id", "term", "inv_idx"), sizes, ["index_id"])


def postings(index: DataFrame) -> DataFrame:
    """``index_id, doc, term, tf, df, cf, n_docs`` of every posting that counts.

    Postings with a null ``doc`` or ``tf`` or with ``tf`` <= 0 don't count; of a ``doc`` listed more than once the last one holds.
    ``df`` and ``cf`` are the documents and occurrences left. Null and empty lists give no rows.
    """
    counted = F.filter("inv_idx", lambda x: x["doc"].isNotNull() & (x["tf"] > 0))
    placed = F.transform(counted, lambda x, i: F.struct(x["doc"].alias("doc"), i.alias("i"), x["tf"].alias("tf")))
    # sorted by doc and place, each posting is paired with the next one: of each run of a doc the last one stays. No lambda looks
    # back at the whole list, so a list costs its own length, however the optimizer arranges these columns
    s = F.sort_array(placed)
    pairs = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda x, y: F.struct(x.alias("x"), (y["doc"] == x["doc"]).alias("again")))
    p = F.transform(F.filter(pairs, lambda z: ~F.coalesce(z["again"], F.lit(False))), lambda z: z["x"])
    rows = current_rows(index).withColumn("p", p).filter(F.size("p") > 0)
    cf = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])
    # counted in a projection of its own: computed next to the explode, they would keep the whole list in every exploded row
    counted_rows = rows.select("index_id", "term", "n_docs", F.size("p").cast("bigint").alias("df"), cf.alias("cf"), "p")
    return counted_rows.select("index_id", "term", "n_docs", "df", "cf", F.explode("p").alias("x")).select(
        "index_id", F.col("x.doc").alias("doc"), "term", F.col("x.tf").alias("tf"), "df", "cf", "n_docs"
    )


def weights(index: DataFrame) -> DataFrame:
    """``index_id, doc, term, tf, df, cf, n_docs, weight, residual, expected, score, norm, share`` of every posting that counts.

    ``residual`` = ln(n_docs / df) - ``expected``, ``score`` = tf * residual, ``weight`` = tf * ln(n_docs / df), ``norm`` = square root of the sum of the squared weights of the document, ``share`` =
    weight / norm (null where the norm is 0). Where the run has no ``doc_count``, all of these are null.
    """
    n, df, cf = (F.col(c).cast("double") for c in ("n_docs", "df", "cf"))
    known = F.col("n_docs") > 0
    observed = F.when(known, F.ln(n / df))
    expected = F.when(known, -F.log1p(-F.exp(-cf / n)))
    by_doc = W.partitionBy("index_id", "doc")
    return (
        postings(index)
        .withColumn("weight", F.col("tf") * observed)
        .withColumn("expected", expected)
        .withColumn("residual", observed - expected)
        .withColumn("score", F.col("tf") * F.col("residual"))
        .withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by_doc)))
        .withColumn("share", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")))
    )


def dominant_terms(index: DataFrame, share: float = 0.8) -> DataFrame:
    """``weights`` of the terms that have at least ``share`` of their document's norm.

    Candidates are the terms whose score with the part that the residual takes off, score + tf * expected, comes that near; the
    share of the weight itself decides.
    """
    near = (F.col("score") + F.col("tf") * F.col("expected")) >= F.col("norm") * (share - 1e-6)
    return weights(index).filter(near & (F.col("share") >= share))


def distinctive_terms(index: DataFrame, share: float = 0.8) -> DataFrame:
    """``index_id, doc, term, score, length, part``: the terms whose score is at least ``share`` of the length of the vector of all
    scores of their document (``part`` = score / length), so terms that their documents are about and that aren't just rare.

    Documents whose scores are all zero, or unknown because their run has no ``doc_count``, have none.
    """
    s = F.col("score")
    scored = weights(index).select("index_id", "doc", "term", "score").withColumn("length", F.sqrt(F.sum(s * s).over(W.partitionBy("index_id", "doc"))))
    return scored.withColumn("part", F.when(F.col("length") > 0, s / F.col("length"))).filter(F.col("part") >= share)


def stored_norms(norms: DataFrame) -> DataFrame:
    """``index_id, doc, stored``: the latest ``doc_norms`` of each document; of equally late ones the largest, nulls last."""
    latest = F.max_by(F.struct("doc_norms"), F.struct("computed_at", F.coalesce("doc_norms", F.lit(float("-inf")))))
    return norms.filter(F.col("index_id").isNotNull() & F.col("doc").isNotNull()).groupBy("index_id", "doc").agg(latest.getField("doc_norms").alias("stored"))


def document_norms(index: DataFrame, norms: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``index_id, doc, n_terms, norm, stored, status`` of every document with a posting that counts.

    ``status``: 'missing' (no stored norm, or null), 'wrong' (NaN, or off by more than ``tolerance`` of the norm) or 'ok'.
    """
    per_doc = weights(index).groupBy("index_id", "doc").agg(F.count(F.lit(1)).alias("n_terms"), F.max("norm").alias("norm"))
    s, n = F.col("stored"), F.coalesce("norm", F.lit(0.0))
    status = F.when(s.isNull(), "missing").when(F.isnan(s) | (F.abs(s - n) > tolerance * F.greatest(n, F.lit(1.0))), "wrong").otherwise("ok")
    return per_doc.join(stored_norms(norms), ["index_id", "doc"], "left").withColumn("status", status)
