"""Lookups in a word list: exact words and patterns with one ``*`` for any, also no, characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

OK, UNSUPPORTED, REFUSED, EMPTY = "ok", "unsupported", "refused", "empty"
#: Characters of a fixed part that words and patterns are joined by.
KEY = 3


#: Names of layouts that a dictionary may be asked for; the engine's own layout serves all of them with the same results.
LAYOUTS = ("array", "btree", "hash", "ternary")


def dictionary(words: DataFrame, layout: str = "array") -> DataFrame:
    """``word, rword``: the distinct words and their reversals (by code point). Null is no word; '' is. ``layout`` is checked, not used."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known: {', '.join(LAYOUTS)}")
    return words.filter(F.col("word").isNotNull()).select("word").distinct().withColumn("rword", F.reverse("word"))


def learn(words: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary of ``words`` with the ``new`` ones."""
    return dictionary(words.select("word").unionAll(new.select("word")))


def size_report(words: DataFrame) -> DataFrame:
    """One row ``n_words, n_chars, n_bytes`` of the distinct words."""
    d = dictionary(words)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return d.agg(F.count(F.lit(1)).alias("n_words"), total(F.length("word")).alias("n_chars"), total(F.octet_length("word")).alias("n_bytes"))


def recognize(words: DataFrame, probes: DataFrame) -> DataFrame:
    """``word, found`` for each row of ``probes``; null is never found."""
    known = words.filter(F.col("word").isNotNull()).select("word").distinct().withColumn("_hit", F.lit(True))
    return probes.select("word").join(known, "word", "left").select("word", F.coalesce("_hit", F.lit(False)).alias("found"))


def status_of(pattern: Column) -> Column:
    p = text.trim(F.coalesce(pattern, F.lit("")))
    stars = F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit("")))
    return F.when(p == "", EMPTY).when(p == "*", REFUSED).when(stars != 1, UNSUPPORTED).otherwise(OK)


def wildcard_status(patterns: DataFrame) -> DataFrame:
    """``query_id, status``: 'empty' (ignored), 'refused' (``*`` alone), 'unsupported' (not exactly one ``*``) or 'ok'."""
    return patterns.select("query_id", status_of(F.col("pattern")).alias("status"))


def matches(word: Column, prefix: Column, suffix: Column) -> Column:
    """Prefix and suffix without overlap; every other character is literal."""
    return F.startswith(word, prefix) & F.endswith(word, suffix) & (F.octet_length(word) >= F.octet_length(prefix) + F.octet_length(suffix))


def lookup(words: DataFrame, pattern: str) -> DataFrame:
    """``word``: the matches of one pattern known beforehand, with both fixed parts pushed down to the scan. ValueError if it isn't 'ok'."""
    p = pattern.strip()
    if p.count("*") != 1:
        raise ValueError("only patterns with one * are supported")
    if p == "*":
        raise ValueError("a pattern needs a fixed part")
    prefix, suffix = p.split("*")
    hit = words
    if prefix:
        hit = hit.filter(F.startswith("word", F.lit(prefix)))
    if suffix:
        hit = hit.filter(F.endswith("word", F.lit(suffix)))
    return hit.filter(F.octet_length("word") >= len((prefix + suffix).encode())).select("word").distinct()


def wildcard(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """``query_id, word``: the matches of every pattern of ``query_id, pattern``.

    Words and patterns meet by the first (or, without a prefix, last) characters of the fixed part, up to three: an equi-join, not
    each pattern with each word. Patterns that aren't 'ok' have no matches.
    """
    p = text.trim(F.col("pattern"))
    parts = (
        patterns.filter(status_of(F.col("pattern")) == OK)
        .select("query_id", F.substring_index(p, "*", 1).alias("prefix"), F.substring_index(p, "*", -1).alias("suffix"))
        .withColumn("_back", F.col("prefix") == "")
        .withColumn("_fixed", F.when(F.col("_back"), F.reverse("suffix")).otherwise(F.col("prefix")))
        .withColumn("_key", F.substring("_fixed", 1, KEY))
        .drop("_fixed")
    )
    known = dictionary(words)
    keys = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(KEY)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    forward = known.select("word", F.lit(False).alias("_back"), F.explode(keys("word")).alias("_key"))
    backward = known.select("word", F.lit(True).alias("_back"), F.explode(keys("rword")).alias("_key"))
    return parts.join(forward.unionAll(backward), ["_back", "_key"]).filter(matches(F.col("word"), F.col("prefix"), F.col("suffix"))).select("query_id", "word")


def ordered(found: DataFrame, by: str = "word") -> DataFrame:
    """Matches in code-point order of the words, or of the reversed words (``by='reversed'``), with ``pos``: the place from 1 in a query."""
    if by not in ("word", "reversed"):
        raise ValueError("by has to be 'word' or 'reversed'")
    key = F.col("word") if by == "word" else F.reverse("word")
    return found.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(key)).cast("bigint")).orderBy("query_id", "pos")
