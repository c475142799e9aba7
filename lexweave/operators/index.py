"""Boolean and term-frequency indexes of a corpus, their statistics and document norms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, weighting
from ..runtime import MAX_ID, Pinned, cut, lookup_join, pinned


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = False) -> DataFrame:
    """``doc, tok_no, form``: the words of each text by white space, numbered from 0. Null and blank texts have none."""
    t = F.lower(text_col) if lower else F.col(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(text.words(t)).alias("tok_no", "form"))


def build_bool_index(lemmas: DataFrame) -> DataFrame:
    """``term, docs``: the sorted distinct documents of each term of ``doc, term``; rows without either are skipped.

    One list a term is what the file format holds. Where a term's documents may be too many for one row, use the exploded form
    (``distinct`` pairs, which every query operator takes) or ``hot_keys.term_documents``, which cuts them into blocks.
    """
    return lemmas.filter(F.col("doc").isNotNull() & F.col("term").isNotNull()).groupBy("term").agg(F.array_sort(F.collect_set("doc")).alias("docs"))


def conllx_lemmas(tokens_: DataFrame) -> DataFrame:
    """``doc, term`` of CoNLL-X tokens with a lemma and, as features, a 32-bit document id; other tokens are left out."""
    return tokens_.select(text.number(F.col("feats"), MAX_ID).alias("doc"), F.col("lemma").alias("term")).filter(F.col("doc").isNotNull() & F.col("term").isNotNull())


def term_frequencies(terms: DataFrame) -> DataFrame:
    """``term, doc, tf`` of ``doc, term``."""
    return terms.filter(F.col("doc").isNotNull() & F.col("term").isNotNull()).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df`` of ``term, doc, tf`` (one row a term and document)."""
    return postings.groupBy("term").agg(F.count("doc").alias("df"))


@dataclass(frozen=True)
class TfIndex:
    """Postings ``term, doc, tf``, statistics ``term, df`` (terms without postings may have df 0), and the two document counts.

    ``n_titles`` is the number of titled documents, by which norms are weighted; ``n_docs`` that of documents with a posting,
    by which queries are. Both are scalar columns, computed with the query that uses them.
    """

    postings: DataFrame
    stats: DataFrame
    n_docs: Column
    n_titles: Column
    shards: int | None = None
    stored_norms: dict[str, DataFrame] = field(default_factory=dict)
    stored: bool = False

    def norms(self, tf: str = "identity") -> DataFrame:
        return self.stored_norms.get(tf) or doc_norms(self.postings, self.stats, self.n_titles, tf, self.stored)

    def of(self, terms: Pinned) -> tuple[DataFrame, DataFrame]:
        """(postings, statistics) of the distinct ``terms`` (``term``) only, reduced where they are read; of a stored index only their shards are."""
        postings, stats = self.postings, self.stats
        if self.shards:
            shards = [r[0] for r in terms.select(shard_of(self.shards)).df.collect()]  # at most as many as there are shards
            postings, stats = (x.filter(F.col("shard").isin(shards)).drop("shard") for x in (postings, stats))
        return lookup_join(postings, terms, ["term"], "left_semi"), lookup_join(stats, terms, ["term"], "left_semi")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")


def save_tf_index(index: TfIndex, path: str, tf: Sequence[str] = ("identity",), shards: int = 64) -> None:
    """Write an index for many queries: postings and statistics in directories by a hash of the term, sorted by term; norms for the
    weightings ``tf``; counts. A frequent term's postings are several files, as partitions are balanced before they are written."""
    index = TfIndex(cut(index.postings), cut(index.stats), index.n_docs, index.n_titles)
    for name, rows, columns in (("postings", index.postings, ("term", "doc", "tf")), ("stats", index.stats, ("term", "df"))):
        placed = rows.select(*columns, shard_of(shards)).hint("rebalance", "shard").sortWithinPartitions("shard", *columns[:-1])
        placed.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{name}")
    for kind in tf:
        index.norms(kind).write.mode("overwrite").parquet(f"{path}/norms/{kind}")
    kinds = F.array(*[F.lit(x) for x in tf]).cast("array<string>")
    counts = index.postings.sparkSession.range(1).select(index.n_docs.alias("n_docs"), index.n_titles.alias("n_titles"), F.lit(shards).alias("shards"), kinds.alias("norms"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def load_tf_index(spark: SparkSession, path: str) -> TfIndex:
    """An index as written by ``save_tf_index``; queries read only what their words need."""
    counts = spark.read.parquet(f"{path}/counts")
    row = counts.first()
    read = lambda name, columns: spark.read.schema(f"{columns}, shard int").parquet(f"{path}/{name}")
    norms = {kind: spark.read.schema("doc bigint, norm double").parquet(f"{path}/norms/{kind}") for kind in row["norms"]}
    return TfIndex(read("postings", "term string, doc bigint, tf bigint"), read("stats", "term string, df bigint"), F.lit(row["n_docs"]), F.lit(row["n_titles"]), row["shards"], norms, stored=True)


def build_tf_index(terms: DataFrame, titles: DataFrame | None = None, keep: bool = True) -> TfIndex:
    """The index of ``doc, term``. ``titles``: ``doc, title``; without it every document with a posting counts as titled.

    ``keep``: write the postings to the shared checkpoint folder, once. Statistics, norms and scores all read them, each with other
    columns, so without it the texts are split again for each.
    """
    postings = cut(term_frequencies(terms)) if keep else term_frequencies(terms)
    n_docs = postings.select(F.countDistinct("doc").alias("n")).scalar()
    n_titles = n_docs if titles is None else titles.select(F.countDistinct("doc").alias("n")).scalar()
    stats = document_frequencies(postings)
    return TfIndex(postings, cut(stats) if keep else stats, n_docs, n_titles, stored=keep)


def index_of_rows(rows: DataFrame, titles: DataFrame | None = None) -> TfIndex:
    """The index of ``term, postings array<struct<doc, tf>>``, as files hold it. A term without postings keeps df 0; of a document
    listed twice the last entry holds."""
    each = rows.select("term", F.posexplode("postings").alias("i", "p")).groupBy("term", F.col("p.doc").alias("doc")).agg(F.max_by("p.tf", "i").alias("tf"))
    stats = rows.select("term").distinct().join(document_frequencies(each), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    n_docs = each.select(F.countDistinct("doc").alias("n")).scalar()
    n_titles = n_docs if titles is None else titles.select(F.countDistinct("doc").alias("n")).scalar()
    return TfIndex(each, stats, n_docs, n_titles)


def doc_norms(postings: DataFrame, stats: DataFrame, n_titles: Column, tf: str = "identity", stored: bool = False) -> DataFrame:
    """``doc, norm``: square root of the sum of (weight(tf) * (ln n_titles - ln df))^2 over the document's terms; infinite without titles."""
    w = weighting.choose(weighting.TF, tf, "weighting")(F.col("tf"))
    x = w * (F.ln(F.when(F.col("_n") > 0, F.col("_n")).cast("double")) - F.ln(F.col("df").cast("double")))
    # a frequent term's postings stay spread
    joined = lookup_join(postings.select("term", "doc", "tf"), pinned(stats.select("term", "df").filter("df > 0"), stored=stored), ["term"], salts=8).withColumn("_n", n_titles).withColumn("_x", x)
    return joined.groupBy("doc").agg(F.coalesce(F.sqrt(F.sum(F.col("_x") * F.col("_x"))), F.lit(float("inf"))).alias("norm"))
