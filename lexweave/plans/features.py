"""Registered queries of the word list, the stopword filter and the n-gram features, over all documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import features, index, wildcard
from ..runtime import table
from .retrieval import LOWER, TOK, corpus, queries_of, words_sql

PATTERNS = [(1, "sort*"), (2, "*ed"), (3, "st*er"), (4, "  the*  "), (5, "*"), (6, "a*b*"), (7, "plain"), (8, " "), (9, "%*"), (10, "üb*"), (11, "index*"), (12, "*ex"), (13, "an*na")]
MINI = ["ab", "aba", "abab", "abba", "zebra", "zebras", "a%b", "über"]
SIZES = (1 << 12, 1 << 13, 1 << 14)
LIMIT = 3


def words(spark, d):
    """The word list: the distinct words of all documents, and a few that show the edges of the rules."""
    return corpus(spark, d).select(F.col("form").alias("word")).unionAll(spark.createDataFrame([(w,) for w in MINI], "word string")).distinct()


def _wild(pattern, spark, d):
    return wildcard.lookup(words(spark, d), pattern)


def wild_batch(spark, d):
    return wildcard.wildcard(words(spark, d), queries_of(spark, PATTERNS).withColumnRenamed("query", "pattern"))


def wild_status(spark, d):
    return wildcard.wildcard_status(queries_of(spark, PATTERNS).withColumnRenamed("query", "pattern"))


def recognize(spark, d):
    """Which title words are words of the documents."""
    probes = index.tokens(table(spark, d, "titles"), "line_no", "title", lower=True).select(F.col("form").alias("word")).distinct()
    return wildcard.recognize(words(spark, d), probes)


def tagged(spark, d):
    """Tokens with a made-up tag by the length of the word: the tables hold no tags."""
    tags = F.array(*[F.lit(t) for t in ("NN", "VBZ", "JJ", "DT", "IN", "RB")])
    return corpus(spark, d).select("doc", "tok_no", "form", F.get(tags, F.length("form") % 6).alias("pos"), F.col("form").alias("lemma"))


def open_class(spark, d):
    return tagged(spark, d).groupBy("pos").agg(F.count_if(features.open_class(F.col("pos"))).alias("n_open"), F.count(F.lit(1)).alias("n"))


def stop_filter_ptb(spark, d):
    return features.content_tokens(tagged(spark, d)).select("doc", F.col("tok_no").cast("bigint").alias("tok_no"), "form")


def content(spark, d):
    return features.content_tokens(tagged(spark, d)).select("doc", "tok_no", "form")


def labelled(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "label")


def label_numbering(spark, d):
    return features.number_labels(labelled(spark, d))


def _grams(n, spark, d):
    return features.ngrams(content(spark, d), n).groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("n"))


def term_ids(spark, d):
    return features.hashed_ngrams(content(spark, d), *SIZES, hash_name="md5")


def hashed_ngrams(spark, d):
    return term_ids(spark, d).groupBy("doc", "term_id").agg(F.count(F.lit(1)).alias("tf"))


def df_threshold(spark, d):
    return features.kept_terms(term_ids(spark, d), LIMIT)


def feature_dims(spark, d):
    return features.number_ids(features.kept_terms(term_ids(spark, d), LIMIT), "term_id")


def _features(kind, spark, d):
    f = features.doc_features(term_ids(spark, d), labelled(spark, d), kind, LIMIT)
    return f.select("doc", "label_id", "dim", F.round("value", 6).alias("value"))


def feature_row_norms(spark, d):
    f = features.doc_features(term_ids(spark, d), labelled(spark, d), "stfidf", LIMIT)
    return f.groupBy("doc").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"), F.count(F.lit(1)).alias("n"))


def libsvm_lines(spark, d):
    return features.libsvm_lines(features.doc_features(term_ids(spark, d), labelled(spark, d), "stfidf", LIMIT), 5)


def _stems(name, spark, d):
    forms = corpus(spark, d).select("form").distinct()
    return forms.select("form", stemming.stem(F.col("form"), name).alias("stem"))


WILD = {"wild_prefix": "sort*", "wild_suffix": "*ed", "wild_circumfix": "st*er", "wild_no_overlap": "ab*ba", "wild_exact_leaf": "zebras*", "wild_literal_percent": "a%*"}
KINDS = ("binary", "tfidf", "btfidf", "stfidf")
QUERIES = {
    **{q.__name__: q for q in (wild_batch, wild_status, recognize, open_class, stop_filter_ptb, label_numbering, hashed_ngrams, df_threshold, feature_dims, feature_row_norms, libsvm_lines)},
    **{n: partial(_wild, p) for n, p in WILD.items()},
    **{n: partial(_grams, i) for i, n in enumerate(("unigrams", "bigrams", "trigrams"), 1)},
    **{f"features_{k}": partial(_features, k) for k in KINDS},
    **{f"stem_{n}": partial(_stems, n) for n in ("porter", "snowball")},
}

# ---------------------------------------------------------------- SQL

WORDS = f"{TOK}, words AS (SELECT DISTINCT word FROM (SELECT form AS word FROM tok UNION ALL SELECT unnest([{', '.join(repr(w) for w in MINI)}])))"
CONTENT = f"""{TOK},
tagged AS (SELECT doc, tok_no, form, ['NN', 'VBZ', 'JJ', 'DT', 'IN', 'RB'][length(form) % 6 + 1] AS pos FROM tok),
content AS (SELECT doc, tok_no, form FROM tagged WHERE pos IN ('NN', 'VBZ', 'JJ', 'RB') AND form NOT IN ('be', 'have'))"""
_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})"
IDS = f"""{CONTENT},
seq AS (SELECT doc, form AS a, lead(form, 1) OVER o AS b, lead(form, 2) OVER o AS c FROM content WINDOW o AS (PARTITION BY doc ORDER BY tok_no)),
ids AS (SELECT doc, {_H.format('a', SIZES[0])} AS term_id FROM seq
  UNION ALL SELECT doc, {SIZES[0]} + {_H.format("a || ' ' || b", SIZES[1])} FROM seq WHERE b IS NOT NULL
  UNION ALL SELECT doc, {SIZES[0] + SIZES[1]} + {_H.format("a || ' ' || b || ' ' || c", SIZES[2])} FROM seq WHERE c IS NOT NULL),
tf AS (SELECT doc, term_id, count(*) AS tf FROM ids GROUP BY ALL),
kept AS (SELECT term_id, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= {LIMIT}),
dims AS (SELECT term_id, row_number() OVER (ORDER BY term_id) AS dim FROM kept)"""
LABELS = "labels AS (SELECT label, row_number() OVER (ORDER BY min(doc_id), label) - 1 AS label_id FROM documents WHERE label IS NOT NULL GROUP BY label)"
_IDF = "ln((SELECT count(DISTINCT doc) FROM tf)::DOUBLE / df)"
_KIND = {"binary": "1.0::DOUBLE", "tfidf": f"tf * {_IDF}", "btfidf": _IDF, "stfidf": f"(1 + ln(tf)) * {_IDF}"}


def _features_sql(kind):
    return f"""WITH {IDS}, {LABELS},
raw AS (SELECT doc, term_id, {_KIND[kind]} AS v FROM tf JOIN kept USING (term_id)),
len AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc)) AS l FROM raw),
f AS (SELECT doc, label_id, dim, CASE WHEN l > 0 THEN v / l ELSE 0 END AS value FROM len JOIN dims USING (term_id) JOIN documents ON doc = doc_id JOIN labels USING (label))"""


def _matches(word, prefix, suffix):
    return f"starts_with({word}, {prefix}) AND ends_with({word}, {suffix}) AND strlen({word}) >= strlen({prefix}) + strlen({suffix})"


_PATS = f"(VALUES {', '.join(f'({i}::BIGINT, {p!r})' for i, p in PATTERNS)}) v(query_id, pattern)"
ORACLES = {
    **{n: f"WITH {WORDS} SELECT word FROM words WHERE {_matches('word', *(repr(x) for x in p.split('*')))}" for n, p in WILD.items()},
    "wild_batch": f"""WITH {WORDS}, p AS (SELECT query_id, trim(pattern) AS p FROM {_PATS}), ok AS (SELECT query_id, split_part(p, '*', 1) AS a, split_part(p, '*', 2) AS b
      FROM p WHERE length(p) - length(replace(p, '*', '')) = 1 AND p <> '*') SELECT query_id, word FROM ok, words WHERE {_matches('word', 'a', 'b')}""",
    "wild_status": f"""SELECT query_id, CASE WHEN trim(pattern) = '' THEN 'empty' WHEN trim(pattern) = '*' THEN 'refused'
      WHEN length(pattern) - length(replace(pattern, '*', '')) <> 1 THEN 'unsupported' ELSE 'ok' END AS status FROM {_PATS}""",
    "recognize": f"""WITH {WORDS}, probes AS (SELECT DISTINCT unnest({words_sql(LOWER.replace('text', 'title'))}) AS word FROM titles WHERE title IS NOT NULL) SELECT word, word IN (SELECT word FROM words) AS found FROM probes""",
    "open_class": f"""WITH {CONTENT} SELECT pos, CAST(count(*) FILTER (pos IN ('NN', 'VBZ', 'JJ', 'RB')) AS BIGINT) AS n_open, count(*) AS n FROM tagged GROUP BY pos""",
    "stop_filter_ptb": f"WITH {CONTENT} SELECT doc, tok_no, form FROM content",
    "label_numbering": f"WITH {LABELS} SELECT label, label_id FROM labels",
    "unigrams": f"WITH {IDS} SELECT doc, a AS gram, count(*) AS n FROM seq GROUP BY ALL",
    "bigrams": f"WITH {IDS} SELECT doc, a || ' ' || b AS gram, count(*) AS n FROM seq WHERE b IS NOT NULL GROUP BY ALL",
    "trigrams": f"WITH {IDS} SELECT doc, a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM seq WHERE c IS NOT NULL GROUP BY ALL",
    "hashed_ngrams": f"WITH {IDS} SELECT doc, term_id, tf FROM tf",
    "df_threshold": f"WITH {IDS} SELECT term_id, df FROM kept",
    "feature_dims": f"WITH {IDS} SELECT term_id, dim FROM dims",
    **{f"features_{k}": f"{_features_sql(k)} SELECT doc, label_id, dim, round(value, 6) AS value FROM f" for k in KINDS},
    "feature_row_norms": f"{_features_sql('stfidf')} SELECT doc, round(sqrt(sum(value * value)), 6) AS norm, count(*) AS n FROM f GROUP BY doc",
    "libsvm_lines": f"{_features_sql('stfidf')} SELECT doc, label_id || ' ' || string_agg(dim || ':' || printf('%.5f', value), ' ' ORDER BY dim) AS line FROM f GROUP BY doc, label_id",
}
