"""Registered queries of the boolean and ranked indexes, over all documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import boolean, index, ranking
from ..runtime import table
from ..sources import sinks

ONE, TWO, THREE, REPEATED, UNKNOWN = "the", "the sorted", "was the compact", "sorted the the sorted", "the zzzunknown"
BATCH = [(1, ONE), (2, TWO), (3, THREE), (4, UNKNOWN), (5, "  "), (6, "wurde der"), (7, "The SORTED Sorted")]


def queries_of(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id bigint, query string")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(table(spark, d, "documents"), lower=True)


def terms(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc", F.col("form").alias("term"))


def doc_titles(spark: SparkSession, d: str) -> DataFrame:
    """``doc, title``: the title on the last line of each document."""
    t = table(spark, d, "titles").filter(F.col("idx").isNotNull())
    return t.groupBy("idx").agg(F.max_by("title", "line_no").alias("title")).select(F.col("idx").alias("doc"), "title")


def made_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"))


def tokenize(spark, d):
    return corpus(spark, d).select("doc", F.col("tok_no").cast("bigint").alias("tok_no"), "form")


def token_counts(spark, d):
    return corpus(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark, d):
    return corpus(spark, d).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def bool_postings(spark, d):
    return terms(spark, d).distinct()


def bool_index_lines(spark, d):
    return sinks.bool_index_lines(index.build_bool_index(terms(spark, d)))


def _and(rows, spark, d, titled=False):
    return boolean.bool_and(terms(spark, d), queries_of(spark, rows), made_titles(spark, d) if titled else None)


def bool_status(spark, d):
    return boolean.bool_status(terms(spark, d), queries_of(spark, BATCH))


def tf_postings(spark, d):
    return index.term_frequencies(terms(spark, d))


def doc_freq(spark, d):
    return index.document_frequencies(index.term_frequencies(terms(spark, d)))


def corpus_stats(spark, d):
    p = index.term_frequencies(terms(spark, d))
    counts = p.agg(F.countDistinct("doc").alias("n_docs"), F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return counts.withColumn("n_titles", doc_titles(spark, d).select(F.count(F.lit(1))).scalar())


def query_idf(spark, d):
    q = ranking.query_idf(index.build_tf_index(terms(spark, d)), queries_of(spark, BATCH))
    return q.select("query_id", F.col("pos").cast("bigint").alias("pos"), "term", F.round("idf", 6).alias("idf"))


def _norms(tf, spark, d):
    return index.build_tf_index(terms(spark, d), doc_titles(spark, d)).norms(tf).select("doc", F.round("norm", 6).alias("norm"))


def _rank(rows, tf, spark, d, titles=None, shown=None, everywhere=False):
    t = terms(spark, d)
    if everywhere:
        t = t.unionAll(t.select("doc").distinct().select("doc", F.lit("everywhere").alias("term")))
    built = index.build_tf_index(t, titles(spark, d) if titles else None)
    return ranking.rank(built, queries_of(spark, rows), tf, digits=6, titles=shown(spark, d) if shown else None)


SIMPLE = (tokenize, token_counts, vocabulary, bool_postings, bool_index_lines, bool_status, tf_postings, doc_freq, corpus_stats, query_idf)
ANDS = {"bool_and_one": [(1, ONE)], "bool_and_two": [(1, TWO)], "bool_and_three": [(1, THREE)], "bool_and_dup_term": [(1, REPEATED)], "bool_and_unknown": [(1, UNKNOWN)], "bool_and_batch": BATCH}
RANKS = {
    **{f"rank_top5_{w}": ([(1, TWO)], w, {}) for w in ("identity", "binary", "sublinear")},
    "rank_repeated_term": ([(1, REPEATED)], "identity", {}),
    "rank_unknown_term": ([(1, UNKNOWN), (2, "zzzunknown")], "identity", {}),
    "rank_ubiquitous_term": ([(1, "everywhere")], "identity", {"everywhere": True}),
    "rank_partial_titles": ([(1, TWO)], "identity", {"titles": doc_titles}),
    "rank_ties_doc_desc": ([(1, "was")], "binary", {}),
    "rank_titles": ([(1, TWO)], "sublinear", {"titles": doc_titles, "shown": doc_titles}),
    "rank_batch": (BATCH, "identity", {}),
}

QUERIES = {
    **{q.__name__: q for q in SIMPLE},
    **{n: partial(_and, rows) for n, rows in ANDS.items()},
    "bool_and_titles": partial(_and, [(1, TWO)], titled=True),
    **{f"doc_norms_{w}": partial(_norms, w) for w in ("identity", "binary", "sublinear")},
    **{n: partial(lambda rows, tf, options, spark, d: _rank(rows, tf, spark, d, **options), rows, tf, options) for n, (rows, tf, options) in RANKS.items()},
}

# ---------------------------------------------------------------- SQL

def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


LOWER = "lower(replace(text, chr(304), 'i' || chr(775)))"
# DuckDB lowers a dotted capital I to one letter, Unicode (and Spark) to two characters
TOK = f"""
parts AS (SELECT doc_id AS doc, {words_sql(LOWER)} AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc, unnest(range(len(w))) AS tok_no, unnest(w) AS form FROM parts)"""
POST = f"""{TOK},
post AS (SELECT form AS term, doc, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"""
LAST_TITLES = "ta AS (SELECT idx AS doc, last(title ORDER BY line_no, loaded_at) AS title FROM titles WHERE idx IS NOT NULL GROUP BY idx)"
W_SQL = {"identity": "({0})::DOUBLE", "binary": "CASE WHEN {0} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "sublinear": "CASE WHEN {0} > 0 THEN 1 + ln({0}) ELSE 0.0::DOUBLE END"}


def values(rows: list[tuple[int, str]]) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in rows) + ") v(query_id, query)"


def _and_sql(rows, titled=False):
    q = f"q AS (SELECT query_id, list_distinct({words_sql('query')}) AS w FROM {values(rows)}), qt AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM q)"
    found = "found AS (SELECT query_id, doc FROM qt JOIN post USING (term) GROUP BY query_id, doc, n HAVING count(*) = n)"
    if not titled:
        return f"WITH {POST}, {q}, {found} SELECT query_id, doc FROM found"
    return f"WITH {POST}, {q}, {found} SELECT query_id, doc, concat_ws('/', source, doc::VARCHAR) AS title FROM found JOIN documents ON doc = doc_id"


def _norm_sql(tf, n_titles):
    return f"norm AS (SELECT doc, sqrt(sum(pow({W_SQL[tf].format('tf')} * (ln({n_titles}) - ln(df)), 2))) AS norm FROM post JOIN st USING (term) GROUP BY doc)"


def _rank_sql(rows, tf, titles=None, shown=None, everywhere=False):
    base = POST
    if everywhere:
        base = f"{TOK}, tok2 AS (SELECT doc, form FROM tok UNION ALL SELECT DISTINCT doc, 'everywhere' FROM tok), post AS (SELECT form AS term, doc, count(*) AS tf FROM tok2 GROUP BY ALL), st AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"
    nd = "(SELECT count(DISTINCT doc) FROM post)"
    nt = "(SELECT count(*) FROM ta)" if titles else nd
    w = W_SQL[tf].format
    return f"""WITH {base}, {LAST_TITLES}, {_norm_sql(tf, nt)},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words_sql('lower(query)')}) AS term FROM {values(rows)}) GROUP BY ALL),
qv AS (SELECT query_id, q.term, coalesce(ln({nd}::DOUBLE / df), 0) AS idf, coalesce(ln({nd}::DOUBLE / df), 0) * {w('qtf')} AS qw FROM q LEFT JOIN st USING (term)),
ql AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY ALL),
dots AS (SELECT query_id, doc, sum(qw * idf * {w('tf')}) AS dot FROM qv JOIN post USING (term) GROUP BY ALL),
s0 AS (SELECT query_id, doc, dot, qn * coalesce(norm, 0) AS den FROM dots JOIN ql USING (query_id) LEFT JOIN norm USING (doc)),
s AS (SELECT query_id, doc, round(CASE WHEN den = 0 AND dot = 0 THEN 0 WHEN den = 0 THEN 'inf'::DOUBLE ELSE dot / den END, 6) AS sim FROM s0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc DESC) AS rank, doc, sim FROM s)
SELECT query_id, rank, doc, sim{", coalesce(title, '') AS title" if shown else ""} FROM r {"LEFT JOIN ta USING (doc)" if shown else ""} WHERE rank <= 5"""


ORACLES = {
    "tokenize": f"WITH {TOK} SELECT doc, tok_no, form FROM tok",
    "token_counts": f"WITH {TOK} SELECT doc, count(*) AS n FROM tok GROUP BY doc",
    "vocabulary": f"WITH {TOK} SELECT form, count(*) AS n FROM tok GROUP BY form",
    "bool_postings": f"WITH {TOK} SELECT DISTINCT form AS term, doc FROM tok",
    "bool_index_lines": f"WITH {TOK}, p AS (SELECT DISTINCT form, doc FROM tok) SELECT form || chr(9) || string_agg(doc::VARCHAR, ' ' ORDER BY doc) AS value FROM p GROUP BY form",
    "bool_status": f"""WITH {TOK}, q AS (SELECT query_id, {words_sql('query')} AS w FROM {values(BATCH)})
SELECT query_id, CASE WHEN len(w) = 0 THEN 'empty' WHEN list_has_all((SELECT list(DISTINCT form) FROM tok), w) THEN 'ok' ELSE 'no_match' END AS status FROM q""",
    "tf_postings": f"WITH {POST} SELECT term, doc, tf FROM post",
    "doc_freq": f"WITH {POST} SELECT term, df FROM st",
    "corpus_stats": f"""WITH {POST} SELECT count(DISTINCT doc) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens,
      (SELECT count(DISTINCT idx) FROM titles) AS n_titles FROM post""",
    "query_idf": f"""WITH {POST}, q AS (SELECT query_id, {words_sql('lower(query)')} AS w FROM {values(BATCH)}),
      qt AS (SELECT query_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM q)
      SELECT query_id, pos, qt.term, round(coalesce(ln((SELECT count(DISTINCT doc) FROM post)::DOUBLE / df), 0), 6) AS idf FROM qt LEFT JOIN st USING (term)""",
    **{n: _and_sql(rows) for n, rows in ANDS.items()},
    "bool_and_titles": _and_sql([(1, TWO)], True),
    **{f"doc_norms_{w}": f"WITH {POST}, {LAST_TITLES}, {_norm_sql(w, '(SELECT count(*) FROM ta)')} SELECT doc, round(norm, 6) AS norm FROM norm" for w in W_SQL},
    **{n: _rank_sql(rows, tf, **options) for n, (rows, tf, options) in RANKS.items()},
}
