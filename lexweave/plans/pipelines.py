"""Registered queries of whole programs and of what only programs use, over all documents, titles and raw lines, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import boolean, features, index, ranking, wildcard
from ..runtime import shared_folder, table
from ..sources import readers, sinks, word2vec
from . import features as feature_queries
from . import loading, retrieval
from .retrieval import BATCH, LAST_TITLES, LOWER, POST, TOK, TWO, W_SQL, queries_of, terms, values, words_sql

SENTENCE = 7
TAGS = ("NN", "VBZ", "JJ", "DT", "IN", "RB")

# ---------------------------------------------------------------- CoNLL-X: the documents written in that format, read again


def conllx_files(spark: SparkSession, d: str) -> DataFrame:
    """``path, value``: each document as a CoNLL-X file of sentences of seven words, some without a lemma, with made-up tags and, as
    features, the document id, or something that isn't one where the word begins with a digit."""
    w = text.words(F.lower("text"))
    tag = lambda f: F.get(F.array(*[F.lit(t) for t in TAGS]), F.length(f) % 6)
    lemma = lambda f: F.when(F.length(f) == 5, "_").otherwise(f)
    feats = lambda f: F.when(f.rlike("^[0-9]"), F.concat(F.lit("x"), f)).otherwise(F.col("doc_id").cast("string"))
    line = lambda f, i: F.concat(
        F.when((i > 0) & (i % SENTENCE == 0), "\n").otherwise(""), F.concat_ws("\t", (i % SENTENCE + 1).cast("string"), f, lemma(f), F.lit("_"), tag(f), feats(f)), F.lit("\n")
    )
    return table(spark, d, "documents").select("path", F.array_join(F.transform(w, line), "").alias("value"))


def conllx_tokens(spark, d):
    t = readers.parse_conllx(conllx_files(spark, d))
    return t.select("path", "label", "sent_no", F.col("tok_no").cast("bigint").alias("tok_no"), "form", "lemma", "pos", "feats")


def program_create_index(spark, d):
    """The boolean index builder: lemmas and document ids of CoNLL-X tokens -> index lines."""
    return sinks.bool_index_lines(index.build_bool_index(index.conllx_lemmas(readers.parse_conllx(conllx_files(spark, d)))))


def labelled_paths(spark, d):
    """The label of each file by its directory; files without one are left out."""
    return readers.parse_conllx(conllx_files(spark, d)).filter(F.col("label").isNotNull()).select("path", "label").distinct()


def program_features(spark, d):
    """The feature program: CoNLL-X files by label -> LIBSVM lines of open-class words and pairs in at least three documents."""
    tokens = readers.parse_conllx(conllx_files(spark, d)).filter(F.col("label").isNotNull()).withColumnRenamed("path", "doc")
    content = features.content_tokens(tokens.withColumn("tok_no", F.struct("sent_no", "tok_no"))).select("doc", "tok_no", "form")
    ids = features.hashed_ngrams(content, *feature_queries.SIZES, hash_name="md5")
    return features.libsvm_lines(features.doc_features(ids, tokens.select("doc", "label").distinct(), "stfidf", feature_queries.LIMIT), 5)


# ---------------------------------------------------------------- the two query programs over the raw lines


def _asked(spark, d) -> DataFrame:
    """Every term of the index lines as a query of its own."""
    loaded = readers.parse_bool_index(loading._lines(spark, d, "index"))
    return loaded.select(F.xxhash64("term").alias("query_id"), F.col("term").alias("query"))


def _by_term(found: DataFrame, asked: DataFrame) -> DataFrame:
    return found.join(asked, "query_id").drop("query_id")


def program_query_index(spark, d):
    """The boolean query program: index and titles lines, every term asked, documents in ascending order with their titles."""
    asked = _asked(spark, d)
    titles = readers.parse_titles(loading._lines(spark, d, "titles"))
    found = boolean.bool_and(readers.parse_bool_index(loading._lines(spark, d, "index")), asked, titles)
    return _by_term(boolean.in_order(found), asked).select("query", "pos", "doc", "title")


def program_rank(spark, d):
    """The ranked query program: weighted index and titles lines, every term asked, the five best documents with their titles."""
    asked = readers.parse_tf_index(loading._lines(spark, d, "index"), "drop").select(F.xxhash64("term").alias("query_id"), F.col("term").alias("query"))
    titles = readers.parse_titles(loading._lines(spark, d, "titles"))
    built = index.index_of_rows(readers.parse_tf_index(loading._lines(spark, d, "index"), "drop"), titles)
    best = ranking.rank(built, asked, "sublinear", digits=6, titles=titles)
    return _by_term(best, asked).select("query", "rank", "doc", "sim", "title")


def titles_failfast(spark, d):
    """The loader that stops at a bad line, over the lines that are none."""
    return readers.parse_titles(readers.accepted(loading._lines(spark, d, "titles"), "titles"), "failfast")


# ---------------------------------------------------------------- orders, all candidates, stemmed queries, a stored index


def bool_and_ordered(spark, d):
    return boolean.in_order(boolean.bool_and(terms(spark, d), queries_of(spark, BATCH)))


def rank_all(spark, d):
    """Every document with a word of a query, with its similarity."""
    s = ranking.similarities(index.build_tf_index(terms(spark, d)), queries_of(spark, BATCH), "sublinear")
    return s.select("query_id", "doc", F.round("sim", 6).alias("sim"))


STEMMED = [(1, "Sorted indexes"), (2, "compacted texts reading"), (3, "documents")]
STEMS = [(1, "sort index"), (2, "compact text read"), (3, "document")]


def _stemmed(name, spark, d):
    return ranking.rank(index.build_tf_index(terms(spark, d)), queries_of(spark, STEMMED), "identity", name, digits=6)


def rank_stored(spark, d):
    """Ranking by an index that was written before."""
    path = shared_folder(spark)
    index.save_tf_index(index.build_tf_index(terms(spark, d)), path, ("sublinear",))
    return ranking.rank(index.load_tf_index(spark, path), queries_of(spark, [(1, TWO)]), "sublinear", digits=6)


PATTERNS = [(1, "sort*"), (2, "*ed"), (3, "re*ed"), (4, "in*")]


def _ordered(by, spark, d):
    """The word list program: words of at least two ASCII letters, matches in their order."""
    words = feature_queries.words(spark, d).filter(F.col("word").rlike("^[a-z]{2,}$"))
    found = wildcard.wildcard(wildcard.dictionary(words, "ternary"), queries_of(spark, PATTERNS).withColumnRenamed("query", "pattern"))
    return wildcard.ordered(found, by)


def word_list(spark, d):
    """The word list reader over all title lines."""
    return readers.parse_words(table(spark, d, "titles").select(F.col("title").alias("value"))).select("word")


def learn_words(spark, d):
    """The dictionary of the documents' words after it has learnt those of the titles."""
    new = index.tokens(table(spark, d, "titles"), "line_no", "title", lower=True).select(F.col("form").alias("word"))
    return wildcard.learn(feature_queries.words(spark, d), new).select("word")


def dictionary_size(spark, d):
    return wildcard.size_report(feature_queries.words(spark, d))


# ---------------------------------------------------------------- numbers, reports, an index that grows


def doc_numbers(spark, d):
    """Files numbered from 0 in the order of their paths, those without words left out."""
    paths = conllx_files(spark, d).filter(F.col("value") != "").select("path")
    return features.number_ids(paths, "path").select("path", (F.col("dim") - 1).alias("doc_no"))


def total_dims(spark, d):
    return features.total_dims(feature_queries.term_ids(spark, d), feature_queries.LIMIT)


def feature_spaces(spark, d):
    return features.spaces(spark, *feature_queries.SIZES)


def append_documents(spark, d):
    """An index of the English documents, to which all others are appended."""
    ids = feature_queries.term_ids(spark, d)
    english = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("doc"))
    old = ids.join(english, "doc", "left_semi")
    numbered = features.append_documents(spark.createDataFrame([], "doc bigint, term_id bigint, tf bigint"), old, -1)
    last = features.number_ids(old, "doc").count() - 1
    return features.append_documents(numbered, ids.join(english, "doc", "left_anti"), last)


def word2vec_scan(spark, d):
    """All embeddings written as word2vec files and read again."""
    path = shared_folder(spark)
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "embedding")
    word2vec.save_word2vec(rows, path)
    return word2vec.read_word2vec(spark, path).select("word", F.posexplode("embedding").alias("j", "x")).select("word", F.col("j").cast("bigint").alias("j"), F.round(F.col("x").cast("double"), 6).alias("x"))


SIMPLE = (
    conllx_tokens, program_create_index, labelled_paths, program_features, program_query_index, program_rank, titles_failfast, bool_and_ordered, rank_all, rank_stored,
    word_list, learn_words, dictionary_size, doc_numbers, total_dims, feature_spaces, append_documents, word2vec_scan,
)
QUERIES = {
    **{q.__name__: q for q in SIMPLE},
    **{f"rank_stemmed_{n}": partial(_stemmed, n) for n in ("porter", "snowball")},
    **{f"wild_ordered_{by}": partial(_ordered, by) for by in ("word", "reversed")},
}

# ---------------------------------------------------------------- SQL

_CONLL = f"""{TOK},
conll AS (SELECT path, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] END AS label, tok_no // {SENTENCE} AS sent_no, tok_no % {SENTENCE} AS tok_no, tok_no AS place, nullif(form, '_') AS form,
  CASE WHEN length(form) <> 5 THEN nullif(form, '_') END AS lemma, {list(TAGS)}[length(form) % 6 + 1] AS pos,
  CASE WHEN regexp_matches(form, '^[0-9]') THEN 'x' || form ELSE doc::VARCHAR END AS feats, doc FROM tok JOIN documents ON doc = doc_id)"""
_CONTENT = "content AS (SELECT path AS doc, place AS tok_no, form FROM conll WHERE label IS NOT NULL AND form IS NOT NULL AND lemma IS NOT NULL AND pos IN ('NN', 'VBZ', 'JJ', 'RB') AND lemma NOT IN ('be', 'have'))"
_FEATURES = feature_queries.IDS.replace(feature_queries.CONTENT, f"{_CONLL}, {_CONTENT}")
_ALL_TITLES = f"tl AS (SELECT CAST(ltrim(a, '+') AS BIGINT) AS doc, arg_max(b, place) AS title FROM tp WHERE a IS NOT NULL AND {loading._TITLE} GROUP BY 1)"
_TITLE_LINES = loading._cut_sql("titles").replace("l AS", "tlines AS", 1).replace("p AS", "tp AS", 1).replace("FROM l)", "FROM tlines)")
_INDEX_LINES = f"{loading._cut_sql('index')}, {loading._IDS}"
_RANKED_TERMS = f"""{_INDEX_LINES}, {loading._valid_sql(2**63 - 1)}, last AS (SELECT a, arg_max(n, place) AS n FROM ok GROUP BY a), {_TITLE_LINES}, {_ALL_TITLES},
pairs AS (SELECT a AS term, i, n[2 * i + 1] AS doc, n[2 * i + 2] AS tf FROM (SELECT a, n, unnest(range(len(n) // 2)) AS i FROM last)),
post AS (SELECT term, doc, arg_max(tf, i) AS tf FROM pairs GROUP BY ALL),
st AS (SELECT a AS term, count(doc) AS df FROM last LEFT JOIN post ON a = term GROUP BY a),
norm AS (SELECT doc, coalesce(sqrt(sum(pow({W_SQL['sublinear'].format('tf')} * (ln((SELECT count(*) FROM tl)) - ln(df)), 2))), 'inf'::DOUBLE) AS norm FROM post JOIN st USING (term) GROUP BY doc),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT a AS query, unnest({words_sql(LOWER.replace('text', 'a'))}) AS term FROM last) GROUP BY ALL),
nd AS (SELECT count(DISTINCT doc) AS nd FROM post),
qv AS (SELECT query, q.term, df = 0 AS hollow, CASE WHEN df > 0 THEN ln(nd::DOUBLE / df) ELSE 0 END AS idf, CASE WHEN df > 0 THEN ln(nd::DOUBLE / df) ELSE 0 END * {W_SQL['sublinear'].format('qtf')} AS qw FROM q LEFT JOIN st USING (term), nd),
ql AS (SELECT query, sqrt(sum(qw * qw)) AS qn, coalesce(bool_or(hollow), false) AS hollow FROM qv GROUP BY query),
dots AS (SELECT query, doc, sum(qw * idf * {W_SQL['sublinear'].format('tf')}) AS dot FROM qv JOIN post USING (term) GROUP BY ALL),
s0 AS (SELECT query, doc, dot, hollow, qn * coalesce(norm, 0) AS den FROM dots JOIN ql USING (query) LEFT JOIN norm USING (doc)),
s AS (SELECT query, doc, round(CASE WHEN hollow OR (den = 0 AND dot = 0) THEN 0 WHEN den = 0 THEN 'inf'::DOUBLE WHEN isnan(dot / den) THEN 0 ELSE dot / den END, 6) AS sim FROM s0),
r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc DESC) AS rank, doc, sim FROM s)"""
_STEM_RANK = retrieval._rank_sql(STEMS, "identity")
_WORDS = feature_queries.WORDS
_PATS = f"(VALUES {', '.join(f'({i}::BIGINT, {p!r})' for i, p in PATTERNS)}) v(query_id, p)"


def _ordered_sql(key):
    return f"""WITH {_WORDS}, m AS (SELECT query_id, word FROM words, {_PATS} WHERE regexp_full_match(word, '[a-z]{{2,}}')
      AND starts_with(word, split_part(p, '*', 1)) AND ends_with(word, split_part(p, '*', 2)) AND length(word) >= length(p) - 1)
      SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY {key}) AS pos FROM m"""


ORACLES = {
    "conllx_tokens": f"WITH {_CONLL} SELECT path, label, sent_no, tok_no, form, lemma, pos, feats FROM conll",
    "program_create_index": f"""WITH {_CONLL}, p AS (SELECT DISTINCT lemma, doc FROM conll WHERE lemma IS NOT NULL AND feats = doc::VARCHAR)
      SELECT lemma || chr(9) || string_agg(doc::VARCHAR, ' ' ORDER BY doc) AS value FROM p GROUP BY lemma""",
    "labelled_paths": f"WITH {_CONLL} SELECT DISTINCT path, label FROM conll WHERE label IS NOT NULL AND label <> ''",
    "program_features": f"""WITH {_FEATURES}, labels AS (SELECT label, row_number() OVER (ORDER BY min(path), label) - 1 AS label_id FROM conll WHERE label IS NOT NULL GROUP BY label),
      raw AS (SELECT doc, term_id, {feature_queries._KIND['stfidf']} AS v FROM tf JOIN kept USING (term_id)), len AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc)) AS l FROM raw),
      f AS (SELECT doc, label_id, dim, CASE WHEN l > 0 THEN v / l ELSE 0 END AS value FROM len JOIN dims USING (term_id) JOIN (SELECT DISTINCT path, label FROM conll) c ON doc = path JOIN labels USING (label))
      SELECT doc, label_id || ' ' || string_agg(dim || ':' || printf('%.5f', value), ' ' ORDER BY dim) AS line FROM f GROUP BY doc, label_id""",
    "program_query_index": f"""WITH {_INDEX_LINES}, {loading._valid_sql(4294967295)}, last AS (SELECT a, arg_max(n, place) AS n FROM ok GROUP BY a), {_TITLE_LINES}, {_ALL_TITLES},
      post AS (SELECT DISTINCT a AS term, unnest(n) AS doc FROM last), q AS (SELECT a AS query, list_distinct({words_sql('a')}) AS w FROM last), qt AS (SELECT query, len(w) AS n, unnest(w) AS term FROM q),
      f AS (SELECT query, doc FROM qt JOIN post USING (term) GROUP BY query, doc, n HAVING count(*) = n)
      SELECT query, row_number() OVER (PARTITION BY query ORDER BY doc) AS pos, doc, coalesce(title, '') AS title FROM f LEFT JOIN tl USING (doc)""",
    "program_rank": f"WITH {_RANKED_TERMS} SELECT query, rank, doc, sim, coalesce(title, '') AS title FROM r LEFT JOIN tl USING (doc) WHERE rank <= 5",
    "titles_failfast": loading.ORACLES["titles_load"],
    "bool_and_ordered": f"WITH f AS ({retrieval._and_sql(BATCH)}) SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY doc) AS pos FROM f",
    "rank_all": retrieval._rank_sql(BATCH, "sublinear").replace("SELECT query_id, rank, doc, sim FROM r  WHERE rank <= 5", "SELECT query_id, doc, sim FROM r"),
    "rank_stored": retrieval._rank_sql([(1, TWO)], "sublinear"),
    "rank_stemmed_porter": _STEM_RANK,
    "rank_stemmed_snowball": _STEM_RANK,
    "wild_ordered_word": _ordered_sql("word"),
    "wild_ordered_reversed": _ordered_sql("reverse(word)"),
    "word_list": "SELECT DISTINCT title AS word FROM titles WHERE title IS NOT NULL",
    "learn_words": f"WITH {_WORDS} SELECT word FROM words UNION SELECT unnest({words_sql(LOWER.replace('text', 'title'))}) FROM titles WHERE title IS NOT NULL",
    "dictionary_size": f"WITH {_WORDS} SELECT count(*) AS n_words, CAST(coalesce(sum(length(word)), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(strlen(word)), 0) AS BIGINT) AS n_bytes FROM words",
    "doc_numbers": f"WITH {TOK}, p AS (SELECT DISTINCT path FROM documents WHERE doc_id IN (SELECT doc FROM tok)) SELECT path, row_number() OVER (ORDER BY path) - 1 AS doc_no FROM p",
    "total_dims": f"WITH {feature_queries.IDS} SELECT (SELECT count(DISTINCT doc) FROM tf) AS n_docs, (SELECT count(DISTINCT term_id) FROM tf) AS n_terms, (SELECT count(*) FROM kept) AS total_dim",
    "feature_spaces": f"""SELECT n::BIGINT AS n, first_dim::BIGINT AS first_dim, buckets::BIGINT AS buckets FROM (VALUES (1, 0, {feature_queries.SIZES[0]}), (2, {feature_queries.SIZES[0]}, {feature_queries.SIZES[1]}),
      (3, {feature_queries.SIZES[0] + feature_queries.SIZES[1]}, {feature_queries.SIZES[2]})) t(n, first_dim, buckets)""",
    "append_documents": f"""WITH {feature_queries.IDS}, d AS (SELECT doc, doc IN (SELECT doc_id FROM documents WHERE lang = 'en') AS en FROM (SELECT DISTINCT doc FROM tf)),
      n AS (SELECT doc, row_number() OVER (ORDER BY NOT en, doc) - 1 AS num FROM d) SELECT num AS doc, term_id, tf FROM tf JOIN n USING (doc)""",
    "word2vec_scan": "SELECT 'w' || vec_id AS word, unnest(range(len(embedding))) AS j, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
}
