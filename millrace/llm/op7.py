"""op7: base rules and cross-document line frequency over all documents, by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import quality_rules
from millrace.llm.registry import query, table

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lines AS (
  SELECT r, source, i, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
    '[^\x20\x09-\x0D]+') AS words
  FROM (
    SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM docs)),
worded AS (SELECT r, source, i, line, array_to_string(words, ' ') AS normal, len(words) AS n FROM lines WHERE len(words) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY r),
prints AS (SELECT r, md5(string_agg(normal, chr(10) ORDER BY i)) AS print FROM worded GROUP BY r),
frequent AS (
  SELECT source, normal FROM worded JOIN prints USING (r)
  GROUP BY source, normal HAVING count(DISTINCT print) > 10),
removed AS (
  SELECT r, sum(n) AS gone FROM worded w JOIN frequent f ON w.normal = f.normal AND w.source IS NOT DISTINCT FROM f.source
  GROUP BY r),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS run
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) > 4)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
stats AS (
  SELECT r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - gone >= 10 AND n_words - gone >= 0.3::DOUBLE * n_words AS kept
FROM judged
"""


@query("op7_quality_rules", SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
