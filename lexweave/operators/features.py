"""Hashed n-gram features of labelled documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, weighting
from ..runtime import cut, lookup_join, shuffle_width

# The open-class tags and tag prefixes, and the verbs without content.
OPEN_TAGS = ("CD", "FW")
OPEN_PREFIXES = ("JJ", "NN", "NP", "RB", "VB")
EMPTY_VERBS = ("be", "have")


def open_class(tag: Column) -> Column:
    return tag.isin(*OPEN_TAGS) | F.substring(tag, 1, 2).isin(*OPEN_PREFIXES)


def ptb_stopword(tag: Column, lemma: Column) -> Column:
    """True for a word that isn't of an open class or is a form of an empty verb (lemma, case-sensitive)."""
    return ~open_class(tag) | lemma.isin(*EMPTY_VERBS)


def content_tokens(tokens: DataFrame, stopword: Callable[[Column, Column], Column] = ptb_stopword) -> DataFrame:
    """``tokens`` (``form, pos, lemma`` and others) with all three fields and no stopword. ``stopword``: (tag, lemma) -> boolean column."""
    present = F.col("form").isNotNull() & F.col("pos").isNotNull() & F.col("lemma").isNotNull()
    return tokens.filter(present & ~stopword(F.col("pos"), F.col("lemma")))


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """``doc, tok_no, gram``: the runs of ``n`` tokens of ``doc, tok_no, form`` that follow each other in the order of ``tok_no``
    (which may have gaps, left by filtered tokens), joined by a space. A document with fewer tokens has none."""
    order = W.partitionBy("doc").orderBy("tok_no")
    parts = [F.col("form"), *[F.lead("form", i).over(order) for i in range(1, n)]]
    joined = tokens.select("doc", "tok_no", F.lead("tok_no", n - 1).over(order).alias("_last") if n > 1 else F.lit(0).alias("_last"), F.concat_ws(" ", *parts).alias("gram"))
    return joined.filter(F.col("_last").isNotNull()).select("doc", "tok_no", "gram")


def hashed_ngrams(tokens: DataFrame, n1: int = 1 << 24, n2: int = 0, n3: int = 0, hash_name: str = "xx") -> DataFrame:
    """``doc, term_id`` of each unigram, bigram and trigram: hash % n1, n1 + hash % n2, n1 + n2 + hash % n3; 0 buckets turn an order off.

    One window over the document serves all three orders.
    """
    if min(n1, n2, n3) < 0 or n1 + n2 + n3 == 0:
        raise ValueError("bucket numbers must not be negative or all 0")
    h = weighting.choose(text.HASHES, hash_name, "hash")
    order = W.partitionBy("doc").orderBy("tok_no")
    b, c = F.lead("form", 1).over(order), F.lead("form", 2).over(order)
    t = tokens.select("doc", F.col("form").alias("a"), (b if n2 or n3 else F.lit(None).cast("string")).alias("b"), (c if n3 else F.lit(None).cast("string")).alias("c"))
    ids = []
    if n1:
        ids.append(h(F.col("a"), n1))
    if n2:
        ids.append(F.when(F.col("b").isNotNull(), n1 + h(F.concat_ws(" ", "a", "b"), n2)))
    if n3:
        ids.append(F.when(F.col("c").isNotNull(), n1 + n2 + h(F.concat_ws(" ", "a", "b", "c"), n3)))
    return t.select("doc", F.explode(F.array(*[i.cast("bigint") for i in ids])).alias("term_id")).filter(F.col("term_id").isNotNull())


def spaces(spark: SparkSession, n1: int, n2: int, n3: int) -> DataFrame:
    """``n, first_dim, buckets``: the dimensions that each order of n-grams is hashed to, as ``hashed_ngrams`` places them."""
    return spark.createDataFrame([(1, 0, n1), (2, n1, n2), (3, n1 + n2, n3)], "n bigint, first_dim bigint, buckets bigint")


def number_labels(docs: DataFrame, order_col: str = "doc") -> DataFrame:
    """``label, label_id``: classes numbered from 0 in the order of their first document. Null is no label. There are few: one window."""
    first = docs.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(order_col).alias("_first"))
    return first.select("label", (F.row_number().over(W.orderBy("_first", "label")) - 1).cast("bigint").alias("label_id"))


def number_ids(ids: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """``<col>, dim``: distinct ids numbered from 1 in their order. Null is no id."""
    return number_rows(ids.select(col).filter(F.col(col).isNotNull()).distinct(), col, parts)


def number_rows(rows: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """``rows`` (distinct in ``col``, without null) with ``dim``, numbered from 1 in the order of ``col``, without gathering them in one task.

    They are sorted in ranges, as many as the shuffle is wide (or ``parts``), and written once; a row's number is its place in its range
    plus the rows of the ranges before.
    """
    sorted_rows = rows.repartitionByRange(parts or shuffle_width(rows.sparkSession), col).sortWithinPartitions(col)
    placed = cut(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a range
    numbered = placed.join(F.broadcast(before), "_part").withColumn("dim", (F.col("_before") + F.col("_place") + 1).cast("bigint"))
    return numbered.select(*rows.columns, "dim")


def total_dims(terms: DataFrame, min_df: int = 1) -> DataFrame:
    """One row ``n_docs, n_terms, total_dim``: documents with a term, distinct terms, and those in at least ``min_df`` documents."""
    df = kept_terms(terms)
    counts = df.agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("df") >= min_df).alias("total_dim"))
    return counts.withColumn("n_docs", terms.select(F.countDistinct("doc")).scalar())


def append_documents(tf: DataFrame, terms: DataFrame, last: int) -> DataFrame:
    """``doc, term_id, tf`` of an index with new documents: ``terms`` has ``doc, term_id`` of theirs, numbered from 0 in any way with gaps;
    they get the numbers after ``last`` in the same order. A document without terms gets none."""
    numbers = number_ids(terms, "doc")
    new = lookup_join(terms.groupBy("doc", "term_id").agg(F.count(F.lit(1)).alias("tf")), numbers, ["doc"])
    return tf.select("doc", "term_id", "tf").unionAll(new.select((F.col("dim") + last).alias("doc"), "term_id", "tf"))


def kept_terms(terms: DataFrame, min_df: int = 1) -> DataFrame:
    """``term_id, df`` of the terms of ``doc, term_id`` that occur in at least ``min_df`` documents."""
    return terms.groupBy("doc", "term_id").count().groupBy("term_id").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def doc_features(terms: DataFrame, docs: DataFrame, feature: str = "stfidf", min_df: int = 1, unit: bool = True) -> DataFrame:
    """``doc, label_id, dim, value``: the weighted terms of each document, rows scaled to length 1.

    ``terms``: ``doc, term_id``; ``docs``: ``doc, label``. ``min_df`` is a document frequency. Dimensions count from 1 in the order of
    the kept term ids. The document count of the idf is that of documents with a term. A row of zeros stays zero. A document
    without terms has no row here and doesn't shift any label; one without a label is left out.
    """
    weigh = weighting.choose(weighting.FEATURES, feature, "feature")
    if min_df < 1:
        raise ValueError("min_df has to be at least 1")
    # read three times below: kept in the shared checkpoint folder instead of counted again
    tf = cut(terms.groupBy("doc", "term_id").agg(F.count(F.lit(1)).alias("tf")))
    n = tf.select(F.countDistinct("doc").alias("n")).scalar()
    kept = number_rows(tf.groupBy("term_id").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df), "term_id")
    labels = docs.join(number_labels(docs), "label").select("doc", "label_id")
    # a term of most documents stays spread: the kept terms are broadcast, or salted where they are many
    raw = lookup_join(tf, kept, ["term_id"]).withColumn("_n", n).withColumn("value", weigh(F.col("tf"), F.col("df"), F.col("_n")).cast("double"))
    if unit:
        length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy("doc")))
        raw = raw.withColumn("_l", length).withColumn("value", F.when(F.col("_l") > 0, F.col("value") / F.when(F.col("_l") > 0, F.col("_l"))).otherwise(0.0))
    return raw.join(labels, "doc").select("doc", "label_id", "dim", "value")


def libsvm_lines(features: DataFrame, digits: int | None = None) -> DataFrame:
    """``doc, line``: ``label dim:value ...`` with ascending dimensions; ``digits`` after the point, or as many as the value has."""
    value = F.col("value").cast("string") if digits is None else F.format_string(f"%.{digits}f", "value")
    cells = F.array_sort(F.collect_list(F.struct("dim", F.concat_ws(":", F.col("dim").cast("string"), value).alias("cell"))))
    rows = features.groupBy("doc", "label_id").agg(cells.alias("cells"))
    return rows.select("doc", F.concat_ws(" ", F.col("label_id").cast("string"), F.array_join(F.transform("cells", lambda x: x["cell"]), " ")).alias("line"))
