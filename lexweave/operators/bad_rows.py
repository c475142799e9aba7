"""Loading of index and titles lines with the bad lines set apart.

Structure is checked line by line with built-in string functions. Values are checked once for each distinct value of a
column: the values that don't parse form a dictionary, which is joined back to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import MAX_ID, lookup_join

COLUMNS, QUOTING, VALUE = "columns", "quoting", "value"


def parses_as_id(c: Column) -> Column:
    """ASCII digits, optionally after one ``+``, of at most 4294967295; leading zeros don't matter."""
    digits = F.regexp_replace(c, r"\A\+?0*", "")
    return c.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 10) & (F.coalesce(digits.try_cast("bigint"), F.lit(0)) <= MAX_ID)


def split_lines(lines: DataFrame) -> DataFrame:
    """Each line once, split into its columns: ``rid, line_id, file, line, structure, term, ids, idx, title``.

    ``structure`` is null or the reason why the line has no columns. A redelivered line (same ``line_id``, file and line) is one
    line; a line without ``line_id`` is told apart by its content. ``file`` other than 'index' and 'titles' (null included) has no
    known layout: 'columns'. An empty table gives no rows.
    """
    once = lines.groupBy("line_id", "file", "line").agg(F.min("loaded_at").alias("loaded_at"))
    line, tab = F.col("line"), F.lit("\t")
    n_tabs = F.length(line) - F.length(F.replace(line, tab, F.lit("")))
    first = F.substring_index(line, "\t", 1)
    rest = F.substring(line, F.length(first) + F.lit(2), F.length(line))
    body = F.substring(rest, F.lit(2), F.length(rest))
    # doubled quotes are blanked with two other characters, so that the first quote left is the closing one
    close = F.locate('"', F.replace(body, F.lit('""'), F.lit("xx")))
    after = F.substring(body, close + F.lit(1), F.length(body))
    quoted = F.startswith(rest, F.lit('"'))
    titles = F.when(
        quoted,
        F.when(close == 0, QUOTING).when(after == "", None).when(F.startswith(after, tab), COLUMNS).otherwise(QUOTING),
    ).when(F.contains(rest, tab), COLUMNS)
    structure = (
        F.when(line.isNull() | (n_tabs == 0), COLUMNS)
        .when(F.col("file") == "index", F.when(n_tabs > 1, COLUMNS))
        .when(F.col("file") == "titles", titles)
        .otherwise(COLUMNS)
    )
    title = F.when(quoted, F.replace(F.substring(body, F.lit(1), close - F.lit(1)), F.lit('""'), F.lit('"'))).otherwise(rest)
    rid = F.coalesce(F.col("line_id").cast("string"), F.concat(F.lit("~"), F.md5(F.concat_ws("\t", "file", "line"))))
    good, index = F.col("structure").isNull(), F.col("file") == "index"
    return (
        once.withColumn("rid", rid)
        .withColumn("structure", structure)
        .withColumn("term", F.when(good & index, first))
        .withColumn("ids", F.when(good & index, F.filter(F.split(rest, " "), lambda t: t != "")))
        .withColumn("idx", F.when(good & ~index, first))
        .withColumn("title", F.when(good & ~index, title))
    )


def cells(split: DataFrame) -> DataFrame:
    """``rid, column, value`` of every value that has to parse."""
    both = F.when(F.col("idx").isNotNull(), F.array(F.struct(F.lit("idx").alias("column"), F.col("idx").alias("value")))).otherwise(
        F.transform(F.array_distinct("ids"), lambda v: F.struct(F.lit("ids").alias("column"), v.alias("value")))
    )
    return split.filter(F.col("structure").isNull()).select("rid", F.explode(both).alias("c")).select("rid", "c.column", "c.value")


def invalid_values(values: DataFrame) -> DataFrame:
    """``column, value, reason``: the dictionary of values that don't parse, each distinct value of a column cast once."""
    return values.select("column", "value").distinct().filter(~parses_as_id(F.col("value"))).withColumn("reason", F.lit(VALUE))


def check_lines(lines: DataFrame) -> DataFrame:
    """``split_lines`` with ``reason``: null for a valid line, else 'columns', 'quoting' or 'value'."""
    split = split_lines(lines)
    values = cells(split)
    # the dictionary is broadcast if it is small, else salted: a value that most lines hold goes to many tasks
    hit = lookup_join(values, invalid_values(values), ["column", "value"]).groupBy("rid").agg(F.min("reason").alias("_value"))
    return split.join(hit, "rid", "left").withColumn(
        "reason", F.coalesce("structure", F.when(F.col("term") == "", VALUE), F.col("_value"))
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """``line_id, reason`` of every bad line, once."""
    return check_lines(lines).filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def loaded_lines(lines: DataFrame) -> DataFrame:
    """``line_id, file, term, ids, idx, title`` of the valid lines; ids are numbers in the order of the line."""
    number = lambda c: F.regexp_replace(c, r"\A\+", "").cast("bigint")
    return check_lines(lines).filter(F.col("reason").isNull()).select("line_id", "file", "term", F.transform("ids", number).alias("ids"), number(F.col("idx")).alias("idx"), "title")
