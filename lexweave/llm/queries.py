"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import burst_trie, density_peaks, leakage, nearest, residual_idf, sentences, trie_tokenizer


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residual_idf.dominant_terms(table(spark, d, "inverted_index")).select("index_id", "doc", "term")


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    w = residual_idf.weights(table(spark, d, "inverted_index"))
    return w.select("index_id", "doc", "term", "tf", "df", "cf", *[F.round(c, 6).alias(c) for c in ("weight", "residual", "score", "norm", "share")])


def p3_distinctive(spark: SparkSession, d: str) -> DataFrame:
    w = residual_idf.distinctive_terms(table(spark, d, "inverted_index"))
    return w.select("index_id", "doc", "term", *[F.round(c, 6).alias(c) for c in ("score", "length", "part")])


def p3_norms(spark: SparkSession, d: str) -> DataFrame:
    n = residual_idf.document_norms(table(spark, d, "inverted_index"), table(spark, d, "query_processor"))
    return n.select("index_id", "doc", "n_terms", F.round("norm", 6).alias("norm"), "status")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    f = burst_trie.term_frequencies(table(spark, d, "query_index"))
    marks = F.filter(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")), lambda x: x.isNotNull())
    return f.select("term", F.explode(marks).alias("mark"))


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return burst_trie.term_frequencies(table(spark, d, "query_index")).select("term", "occurrences", "documents", "rare", "common")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.mutual_neighbours(table(spark, d, "kmeans")).select("row_a", "row_b")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows, however far, of every row whose id 20 divides, against all rows."""
    return nearest.nearest_rows(table(spark, d, "kmeans")).select("row_id", "other")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return density_peaks.neighbour_pairs(table(spark, d, "kmeans"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kmeans")
    return density_peaks.described(density_peaks.clusters(rows), rows.select("row_id", "word")).withColumn("words", F.array_join("words", " "))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return trie_tokenizer.encode_texts(table(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


_WEIGHTS = """
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_id, term ORDER BY built_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn
                        FROM inverted_index WHERE index_id IS NOT NULL AND term IS NOT NULL) WHERE rn = 1),
sizes AS (SELECT index_id, max(doc_count) AS n_docs FROM inverted_index GROUP BY index_id),
raw AS (SELECT index_id, term, unnest(inv_idx) AS x, generate_subscripts(inv_idx, 1) AS i FROM held),
post AS (SELECT index_id, term, x.doc AS doc, arg_max(x.tf, i) AS tf FROM raw WHERE x.doc IS NOT NULL AND x.tf > 0 GROUP BY ALL),
stat AS (SELECT index_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY ALL),
w0 AS (SELECT p.*, s.df, s.cf, z.n_docs, tf * ln(n_docs::DOUBLE / df) AS weight, ln(n_docs::DOUBLE / df) + ln(1 - exp(-cf / n_docs::DOUBLE)) AS residual
       FROM post p JOIN stat s USING (index_id, term) JOIN sizes z USING (index_id)),
w1 AS (SELECT *, tf * residual AS score, sqrt(sum(weight * weight) OVER (PARTITION BY index_id, doc)) AS norm FROM w0),
w AS (SELECT *, CASE WHEN norm > 0 THEN weight / norm END AS share FROM w1)
"""

_COUNTS = """
once AS (SELECT any_value(term) AS term, any_value(idxs) AS idxs FROM query_index
         GROUP BY line_id, CASE WHEN line_id IS NULL THEN hash(shard, term, idxs, written_at) END),
n AS (SELECT term, CAST(sum(len(list_filter(coalesce(idxs, []), lambda x: x BETWEEN 0 AND 4294967295))) AS BIGINT) AS occurrences FROM once
      WHERE term IS NOT NULL AND term <> '' GROUP BY term),
ids AS (SELECT DISTINCT term, x FROM (SELECT term, unnest(idxs) AS x FROM query_index) WHERE x BETWEEN 0 AND 4294967295),
d AS (SELECT term, count(*) AS documents FROM ids GROUP BY term),
f0 AS (SELECT n.term, occurrences, coalesce(documents, 0) AS documents FROM n LEFT JOIN d USING (term)),
f AS (SELECT *, documents < 3 AS rare, documents > 0 AND documents >= 0.25 * (SELECT count(DISTINCT x) FROM ids) AS common FROM f0)
"""

# every usable vector with every other: for the small tables that SQL is run on
_PAIRS = """
u AS (SELECT DISTINCT row_id, embedding AS v FROM kmeans WHERE row_id IS NOT NULL AND len(embedding) = 128
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
g AS (SELECT row_id, list_transform(v, lambda x: x::DOUBLE) AS v FROM u),
pairs AS (SELECT a.row_id AS row_id, b.row_id AS other, list_cosine_similarity(a.v, b.v) AS cos FROM g a JOIN g b ON a.row_id <> b.row_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(cos, 12) DESC, other) AS r FROM pairs) WHERE r <= 5),
near AS (SELECT row_id, other FROM pairs WHERE cos >= 0.65),
d AS (SELECT row_id, count(*) AS density FROM near GROUP BY row_id),
best AS (SELECT n.row_id, n.other, d.density, row_number() OVER (PARTITION BY n.row_id ORDER BY d.density DESC, n.other) AS r FROM near n JOIN d ON d.row_id = n.other),
c AS (SELECT d.row_id, d.density, CASE WHEN b.density > d.density OR (b.density = d.density AND b.other < d.row_id) THEN b.other ELSE d.row_id END AS cluster
      FROM d JOIN best b ON b.row_id = d.row_id AND r = 1 WHERE d.density >= 4)
"""

QUERIES = {q.__name__: q for q in (p3_found, p3_weights, p3_distinctive, p3_norms, p4_found, p4_frequencies, p5_found, p5_neighbours, p6_found, p6_clusters, p7_ids, p8_found, p8_spans, p9_found)}

ORACLES = {
    "p3_found": f"WITH {_WEIGHTS} SELECT index_id, doc, term FROM w WHERE share >= 0.8",
    "p3_weights": f"""WITH {_WEIGHTS} SELECT index_id, doc, term, tf, df, cf, round(weight, 6) AS weight, round(residual, 6) AS residual,
      round(score, 6) AS score, round(norm, 6) AS norm, round(share, 6) AS share FROM w""",
    "p3_distinctive": f"""WITH {_WEIGHTS}, v AS (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY index_id, doc)) AS length FROM w)
      SELECT index_id, doc, term, round(score, 6) AS score, round(length, 6) AS length, round(score / length, 6) AS part FROM v WHERE length > 0 AND score / length >= 0.8""",
    "p3_norms": f"""WITH {_WEIGHTS}, docs AS (SELECT index_id, doc, count(*) AS n_terms, max(norm) AS norm FROM w GROUP BY ALL),
      stored AS (SELECT index_id, doc, doc_norms AS s FROM (SELECT *, row_number() OVER (PARTITION BY index_id, doc ORDER BY computed_at DESC NULLS LAST, doc_norms DESC NULLS LAST) AS rn
                 FROM query_processor WHERE index_id IS NOT NULL AND doc IS NOT NULL) WHERE rn = 1)
      SELECT index_id, doc, n_terms, round(norm, 6) AS norm, CASE WHEN s IS NULL THEN 'missing'
        WHEN isnan(s) OR abs(s - coalesce(norm, 0)) > 1e-6 * greatest(coalesce(norm, 0), 1) THEN 'wrong' ELSE 'ok' END AS status
      FROM docs LEFT JOIN stored USING (index_id, doc)""",
    "p4_found": f"""WITH {_COUNTS} SELECT term, 'rare' AS mark FROM f WHERE rare UNION ALL SELECT term, 'common' FROM f WHERE common""",
    "p5_found": f"WITH {_PAIRS} SELECT a.row_id AS row_a, a.other AS row_b FROM top a JOIN top b ON a.row_id = b.other AND a.other = b.row_id WHERE a.row_id < a.other AND a.cos >= 0.96",
    "p5_neighbours": f"WITH {_PAIRS} SELECT row_id, other FROM top WHERE row_id % 20 = 0",
    "p6_found": f"WITH {_PAIRS} SELECT n.row_id AS row_a, n.other AS row_b FROM near n JOIN d USING (row_id) WHERE n.row_id < n.other AND density >= 4",
    "p6_clusters": f"""WITH {_PAIRS}, w AS (SELECT row_id, min(word) AS word FROM kmeans WHERE word IS NOT NULL GROUP BY row_id),
      t AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY density DESC, row_id) AS r FROM c JOIN w USING (row_id)),
      l AS (SELECT cluster, string_agg(word, ' ' ORDER BY r) AS words FROM t WHERE r <= 3 GROUP BY cluster)
      SELECT cluster, count(*) AS size, any_value(coalesce(words, '')) AS words FROM c LEFT JOIN l USING (cluster) GROUP BY cluster""",
    "p4_frequencies": f"WITH {_COUNTS} SELECT term, occurrences, documents, rare, common FROM f",
}
