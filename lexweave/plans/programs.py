"""Whole programs from files to files or answers, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boolean, clustering, features, index, ranking, wildcard
from ..runtime import cut
from ..sources import readers, sinks, word2vec


def create_bool_index(spark: SparkSession, conllx: str, out: str) -> None:
    """Lemmas and the document ids in the feature column of CoNLL-X files -> ``term TAB id id ...``."""
    tokens = readers.read_conllx(spark, conllx, whole_files=False)
    sinks.write_bool_index(index.build_bool_index(index.conllx_lemmas(tokens)), out)


def query_bool_index(spark: SparkSession, index_path: str, queries: DataFrame, titles_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``query_id, doc[, title]``, ``query_id, status``) of conjunctive queries over an index file."""
    built = readers.read_bool_index(spark, index_path)
    titles = readers.read_titles(spark, titles_path) if titles_path else None
    return boolean.bool_and(built, queries, titles), boolean.bool_status(built, queries)


def query_tf_index(spark: SparkSession, index_path: str, titles_path: str, queries: DataFrame, stemmer: str = "none", weighting: str = "identity", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(``query_id, rank, doc, sim, title``, ``query_id, pos, term, idf``) of ranked queries over a weighted index and a titles file;
    a line that doesn't load raises."""
    titles = readers.read_titles(spark, titles_path, "failfast", readers.MAX_LONG)
    built = index.index_of_rows(readers.read_tf_index(spark, index_path), titles)
    return ranking.rank(built, queries, weighting, stemmer, k, titles), ranking.query_idf(built, queries, stemmer)


def query_words(spark: SparkSession, words_path: str, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``query_id, word``, ``query_id, status``) of single-``*`` patterns over a word list file."""
    return wildcard.wildcard(readers.read_words(spark, words_path), patterns), wildcard.wildcard_status(patterns)


def write_features(
    spark: SparkSession, corpus: str, out: str, n1: int = 1 << 24, n2: int = 0, n3: int = 0, min_df: int = 1, feature: str = "stfidf", stopword=features.ptb_stopword
) -> None:
    """A directory of ``label/file`` CoNLL-X documents -> LIBSVM lines. ``min_df`` is a document frequency. Files without a label are left out."""
    tokens = readers.read_conllx(spark, corpus).filter(F.col("label").isNotNull()).withColumnRenamed("path", "doc")
    # one running number through the sentences of a document: n-grams may cross them
    numbered = tokens.withColumn("tok_no", F.struct("sent_no", "tok_no"))
    content = features.content_tokens(numbered, stopword).select("doc", "tok_no", "form")
    docs = tokens.select("doc", "label").distinct()
    sinks.write_libsvm(features.doc_features(features.hashed_ngrams(content, n1, n2, n3), docs, feature, min_df), out)


def write_word_clusters(spark: SparkSession, vectors: str, out: str, k: int | None = None, epsilon: float = 0.05, max_iter: int = 25, verbose: bool = True) -> None:
    """A word2vec binary file -> ``word TAB cluster``."""
    rows = cut(word2vec.read_word2vec(spark, vectors))  # parsed once, read in each step
    found = clustering.kmeans(rows, k, epsilon, max_iter, verbose, unit=True)
    sinks.write_clusters(rows.select("row_id", "word").join(clustering.assign(rows, found.centroids, unit=True), "row_id").select("word", "cluster"), out)
