"""Queries of the general training-data operators over the whole driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bad_rows, hot_keys
from ..runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hot_terms(table(spark, d, "query_index")).select("term", "kind")


def p1_loads(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.term_loads(table(spark, d, "query_index")).select("term", "n_rows", "n_entries")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = hot_keys.term_documents(table(spark, d, "query_index"))
    return docs.select(
        "term", "block", F.size("docs").cast("bigint").alias("n_docs"), F.array_join(F.transform("docs", lambda x: x.cast("string")), " ").alias("docs")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.bad_lines(table(spark, d, "raw_lines"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    lines = bad_rows.loaded_lines(table(spark, d, "raw_lines"))
    return lines.select("line_id", "file", "term", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "idx", "title")


_LINES = """
once AS (SELECT any_value(term) AS term, any_value(idxs) AS idxs FROM query_index
         GROUP BY line_id, CASE WHEN line_id IS NULL THEN hash(shard, term, idxs, written_at) END),
valid AS (SELECT term, len(list_filter(coalesce(idxs, []), lambda x: x BETWEEN 0 AND 4294967295)) AS n FROM once),
loads AS (SELECT term, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_entries FROM valid GROUP BY term)
"""

_SPLIT = r"""
once AS (SELECT DISTINCT line_id, file, line FROM raw_lines),
cut AS (SELECT *, strpos(line, chr(9)) AS tab, length(line) - length(replace(line, chr(9), '')) AS tabs FROM once),
part AS (SELECT *, CASE WHEN tab > 0 THEN substr(line, 1, tab - 1) END AS head, CASE WHEN tab > 0 THEN substr(line, tab + 1) END AS rest FROM cut),
quote AS (SELECT *, rest LIKE '"%' AS quoted, strpos(replace(substr(rest, 2), '""', 'xx'), '"') AS stop FROM part),
shape AS (SELECT *, CASE
    WHEN line IS NULL OR tabs = 0 THEN 'columns'
    WHEN file = 'index' THEN CASE WHEN tabs > 1 THEN 'columns' END
    WHEN file = 'titles' THEN CASE
        WHEN quoted AND stop = 0 THEN 'quoting'
        WHEN quoted AND substr(rest, stop + 2) = '' THEN NULL
        WHEN quoted AND substr(rest, stop + 2, 1) = chr(9) THEN 'columns'
        WHEN quoted THEN 'quoting'
        WHEN strpos(rest, chr(9)) > 0 THEN 'columns' END
    ELSE 'columns' END AS structure FROM quote),
vals AS (SELECT *, CASE WHEN structure IS NULL THEN CASE WHEN file = 'index' THEN list_filter(string_split(rest, ' '), lambda v: v <> '') ELSE [head] END END AS v FROM shape),
ok AS (SELECT *, CASE WHEN structure IS NOT NULL THEN structure
    WHEN file = 'index' AND head = '' THEN 'value'
    WHEN len(list_filter(v, lambda x: NOT (regexp_full_match(x, '[+]?[0-9]+') AND coalesce(try_cast(ltrim(x, '+') AS HUGEINT), 4294967296::HUGEINT) <= 4294967295))) > 0 THEN 'value' END AS reason FROM vals)
"""

QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_loads, p1_documents, p2_found, p2_loaded)}

ORACLES = {
    "p1_found": f"""WITH {_LINES}
SELECT term, kind FROM (
  SELECT term, unnest(['rows', 'entries']) AS kind, unnest([n_rows, n_entries]) AS n,
         unnest([(SELECT sum(n_rows) FROM loads), (SELECT sum(n_entries) FROM loads)]) AS total
  FROM loads WHERE term IS NOT NULL AND term <> '') WHERE n > 0 AND n * 50 >= total""",
    "p1_loads": f"WITH {_LINES} SELECT term, n_rows, n_entries FROM loads",
    "p1_documents": """WITH
ids AS (SELECT DISTINCT term, x FROM (SELECT term, unnest(idxs) AS x FROM query_index WHERE term IS NOT NULL AND term <> '') WHERE x BETWEEN 0 AND 4294967295),
full_terms AS (SELECT term, x >> 14 AS block, count(*) AS n_docs, string_agg(x::VARCHAR, ' ' ORDER BY x) AS docs FROM ids GROUP BY ALL)
SELECT * FROM full_terms UNION ALL
SELECT term, NULL, 0, '' FROM (SELECT DISTINCT term FROM query_index WHERE term IS NOT NULL AND term <> '') WHERE term NOT IN (SELECT term FROM ids)""",
    "p2_found": f"WITH {_SPLIT} SELECT DISTINCT line_id, reason FROM ok WHERE reason IS NOT NULL",
    "p2_loaded": f"""WITH {_SPLIT}
SELECT line_id, file, CASE WHEN file = 'index' THEN head END AS term,
  CASE WHEN file = 'index' THEN array_to_string(list_transform(v, lambda x: CAST(CAST(ltrim(x, '+') AS BIGINT) AS VARCHAR)), ' ') END AS ids,
  CASE WHEN file = 'titles' THEN CAST(ltrim(head, '+') AS BIGINT) END AS idx,
  CASE WHEN file = 'titles' THEN CASE WHEN quoted THEN replace(substr(rest, 2, stop - 1), '""', '"') ELSE rest END END AS title
FROM ok WHERE reason IS NULL""",
}
