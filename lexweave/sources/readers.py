"""Readers of the text formats. ``mode``: 'permissive' (bad lines set apart), 'drop' (left out) or 'failfast' (raise)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import MAX_ID

CONLLX = ("id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel")
MODES = ("permissive", "drop", "failfast")
MAX_LONG = 2**63 - 1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, at``: the lines of all files below ``path``; a closing carriage return is cut off. Lines of one file are in the
    order of ``at`` (which isn't consecutive); a file is read by several tasks."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # cut by plain string functions: they leave bytes that are no UTF-8 as they are
    bare = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return lines.select(bare.alias("value"), F.col("_metadata.file_path").alias("file"), order.alias("at"))


def _checked(df: DataFrame, valid: Column, mode: str, what: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "failfast":
        return df.filter(F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: bad line: "), F.coalesce("value", F.lit("null")))).cast("boolean")))
    return df.filter(valid)


def rejected(lines: DataFrame, kind: str, largest: int = MAX_ID) -> DataFrame:
    """The lines that the permissive parsers leave out; ``kind``: 'bool_index', 'tf_index' or 'titles', of which ``largest`` is the largest id."""
    return lines.filter(~_accepted(kind, largest))


def accepted(lines: DataFrame, kind: str, largest: int = MAX_ID) -> DataFrame:
    """The lines that are not ``rejected``."""
    return lines.filter(_accepted(kind, largest))


def _accepted(kind: str, largest: int) -> Column:
    return F.coalesce({"bool_index": _bool_valid, "tf_index": _tf_valid, "titles": lambda: _title_valid(largest)}[kind](), F.lit(False))


def _ids() -> Column:
    return text.words(text.after_tab(F.col("value")))


def _bool_valid() -> Column:
    return F.forall(_ids(), lambda v: text.number(v, MAX_ID).isNotNull())


def _tf_valid() -> Column:
    return F.forall(_ids(), lambda v: text.number(v, MAX_LONG).isNotNull())


def _title_valid(largest: int) -> Column:
    return text.number(text.before_tab(F.col("value")), largest).isNotNull()


def parse_bool_index(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    """``term, docs`` of ``value, at`` lines ``term TAB id id ...``: sorted distinct ids, an empty list kept; of several lines of a term the last holds."""
    rows = _checked(lines, F.coalesce(_bool_valid(), F.lit(False)), mode, "boolean index")
    docs = F.array_sort(F.array_distinct(F.transform(_ids(), lambda v: text.number(v, MAX_ID))))
    return rows.select("at", text.before_tab(F.col("value")).alias("term"), docs.alias("docs")).groupBy("term").agg(F.max_by("docs", "at").alias("docs"))


def parse_tf_index(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``term, postings array<struct<doc, tf>>`` of ``value, at`` lines ``term TAB doc tf doc tf ...``, as listed; an odd last value is
    dropped; of several lines of a term the last holds."""
    rows = _checked(lines, F.coalesce(_tf_valid(), F.lit(False)), mode, "weighted index")
    v = F.transform(_ids(), lambda x: text.number(x, MAX_LONG))
    # pair every value with the one after it, keep the pairs at even places: no lambda looks back at the whole list
    pairs = F.zip_with(v, F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), lambda x, y: F.struct(x.alias("doc"), y.alias("tf")))
    postings = F.filter(pairs, lambda p, i: (i % 2 == 0) & p["tf"].isNotNull())
    return rows.select("at", text.before_tab(F.col("value")).alias("term"), postings.alias("postings")).groupBy("term").agg(F.max_by("postings", "at").alias("postings"))


def parse_titles(lines: DataFrame, mode: str = "permissive", largest: int = MAX_ID) -> DataFrame:
    """``doc, title`` of ``value, at`` lines ``id TAB title`` (a title may hold tabs); of several lines of an id the last holds."""
    number = text.number(text.before_tab(F.col("value")), largest)
    rows = _checked(lines, number.isNotNull(), mode, "titles")
    return rows.select("at", number.alias("doc"), text.after_tab(F.col("value")).alias("title")).groupBy("doc").agg(F.max_by("title", "at").alias("title"))


def read_bool_index(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    return parse_bool_index(read_lines(spark, path), mode)


def read_tf_index(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    return parse_tf_index(read_lines(spark, path), mode)


def read_titles(spark: SparkSession, path: str, mode: str = "permissive", largest: int = MAX_ID) -> DataFrame:
    return parse_titles(read_lines(spark, path), mode, largest)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, rword`` of the lines of word list files, as ``parse_words``."""
    return parse_words(read_lines(spark, path))


def parse_words(lines: DataFrame) -> DataFrame:
    """``word, rword``: the distinct ``value`` lines, untrimmed, and their reversals; null lines and lines that are no UTF-8 are dropped."""
    words = lines.filter(F.col("value").isNotNull() & F.is_valid_utf8("value")).select(F.col("value").alias("word")).distinct()
    return words.withColumn("rword", F.reverse("word"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query``: a query a line, numbered by file and place."""
    return read_lines(spark, path).select(F.xxhash64("file", "at").alias("query_id"), F.col("value").alias("query"))


def read_conllx(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """``path, label, sent_no, tok_no`` and the ten CoNLL-X columns (``_`` is null; missing columns too) of all files below ``path``.

    ``label`` is the name of the file's directory (null right below the root of the file system). ``whole_files``: a file is one
    row of one task, which numbers sentences and tokens through it: right for corpora of many documents. Otherwise a large file is
    split between sentences (files with line feeds only), and ``sent_no`` only orders them.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if whole_files:
        return parse_conllx(reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    parts = reader.option("lineSep", "\n\n").text(path).filter(text.trim(F.col("value")) != "")
    return _tokens(parts.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("sent_no"), F.col("value").alias("sentence")))


def parse_conllx(files: DataFrame) -> DataFrame:
    """The tokens, as of ``read_conllx``, of whole files ``path, value``. A null value has none; a null path has no label."""
    plain = files.select("path", F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    blocks = F.filter(F.split("value", r"\n[ \t]*(?:\n[ \t]*)+"), lambda s: text.trim(s) != "")
    return _tokens(plain.select("path", F.posexplode(blocks).alias("sent_no", "sentence")))


def _tokens(sentences: DataFrame) -> DataFrame:
    lines = F.filter(F.split("sentence", "\n"), lambda s: text.trim(s) != "")
    tokens = sentences.select("path", "sent_no", F.posexplode(lines).alias("tok_no", "line"))
    cells = F.split("line", "\t")
    field = lambda i: F.when(F.get(cells, F.lit(i)) != "_", F.get(cells, F.lit(i)))
    label = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return tokens.select(
        "path", F.when(label != "", F.url_decode(label)).alias("label"), F.col("sent_no").cast("bigint").alias("sent_no"), "tok_no", *[field(i).alias(n) for i, n in enumerate(CONLLX)]
    )
