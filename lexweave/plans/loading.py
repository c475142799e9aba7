"""Registered queries of the loaders, over all raw lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..runtime import table
from ..sources import readers, sinks


def _lines(spark, d, file):
    """The lines of one of the two files in the order of their numbers, each delivery of a line once."""
    return table(spark, d, "raw_lines").filter(F.col("file") == file).select(F.col("line").alias("value"), F.col("line_id").alias("at")).distinct()


def bool_index_load(spark, d):
    return sinks.bool_index_lines(readers.parse_bool_index(_lines(spark, d, "index")))


def tf_index_load(spark, d):
    return sinks.tf_index_lines(readers.parse_tf_index(_lines(spark, d, "index"), "drop"))


def titles_load(spark, d):
    return readers.parse_titles(_lines(spark, d, "titles"))


def titles_rejected(spark, d):
    return readers.rejected(_lines(spark, d, "titles"), "titles").select("value")


QUERIES = {q.__name__: q for q in (bool_index_load, tf_index_load, titles_load, titles_rejected)}



def _cut_sql(file: str) -> str:
    return f"""
l AS (SELECT DISTINCT line AS value, line_id AS place FROM raw_lines WHERE file = '{file}'),
p AS (SELECT *, CASE WHEN strpos(value, chr(9)) > 0 THEN substr(value, 1, strpos(value, chr(9)) - 1) END AS a,
             CASE WHEN strpos(value, chr(9)) > 0 THEN substr(value, strpos(value, chr(9)) + 1) END AS b FROM l)"""


_NUMBER = "regexp_full_match({0}, '[+]?[0-9]+') AND coalesce(try_cast(ltrim({0}, '+') AS HUGEINT), 9223372036854775808::HUGEINT) <= {1}"
_IDS = f"v AS (SELECT *, list_filter(regexp_split_to_array(b, '{SPACE}+'), lambda w: w <> '') AS w FROM p WHERE a IS NOT NULL)"


def _valid_sql(largest: int) -> str:
    return f"ok AS (SELECT a, place, list_transform(w, lambda x: CAST(ltrim(x, '+') AS BIGINT)) AS n FROM v WHERE len(list_filter(w, lambda x: NOT ({_NUMBER.format('x', largest)}))) = 0)"


_TITLE = _NUMBER.format("a", 4294967295)
ORACLES = {
    "bool_index_load": f"""WITH {_cut_sql("index")}, {_IDS}, {_valid_sql(4294967295)}, last AS (SELECT a, arg_max(n, place) AS n FROM ok GROUP BY a)
      SELECT a || chr(9) || array_to_string(list_sort(list_distinct(n)), ' ') AS value FROM last""",
    "tf_index_load": f"""WITH {_cut_sql("index")}, {_IDS}, {_valid_sql(2**63 - 1)}, last AS (SELECT a, arg_max(n, place) AS n FROM ok GROUP BY a)
      SELECT a || chr(9) || array_to_string(n[1 : len(n) - len(n) % 2], ' ') AS value FROM last""",
    "titles_load": f"WITH {_cut_sql('titles')} SELECT CAST(ltrim(a, '+') AS BIGINT) AS doc, arg_max(b, place) AS title FROM p WHERE a IS NOT NULL AND {_TITLE} GROUP BY 1",
    "titles_rejected": f"WITH {_cut_sql('titles')} SELECT value FROM p WHERE a IS NULL OR NOT ({_TITLE})",
}
