"""op6: all documents without the later copies of repeated runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.registry import query, table

SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM split),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i,
    sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto
  FROM counted WHERE words > 0),
runs AS (
  SELECT a.doc_id, a.i AS first, count(*) AS t, string_agg(b.line, chr(10) ORDER BY b.i) AS run
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
    AND b.upto - b.words < a.upto - a.words + 50
  GROUP BY a.doc_id, a.i HAVING sum(b.words) >= 50
  UNION
  SELECT a.doc_id, min(b.i), count(*), string_agg(b.line, chr(10) ORDER BY b.i)
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 49 AND a.i AND b.upto > a.upto - 50
  GROUP BY a.doc_id, a.i HAVING sum(b.words) >= 50),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, first + t)) AS i FROM placed WHERE place > 1),
marked AS (
  SELECT doc_id, n, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone JOIN lines USING (doc_id, i)),
stretches AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM marked GROUP BY doc_id, island),
cut AS (
  SELECT split.doc_id, split.n, split.line, bool_or(split.n BETWEEN s.a AND s.b) IS TRUE AS removed
  FROM split LEFT JOIN stretches s ON split.doc_id = s.doc_id GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT removed), '') AS text,
  count(*) FILTER (removed) AS lines_removed
FROM cut GROUP BY doc_id
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
