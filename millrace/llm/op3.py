"""op3: the mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.registry import keep, query, table


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    3 * source_size AS most
  FROM sources),
marked AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (
      ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    > most * sum(weight) OVER (
      ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_most
  FROM weighted),
aimed AS (
  SELECT source, source_size, CASE WHEN at_most THEN most::DOUBLE ELSE
    ((sum(source_size) OVER () - sum(CASE WHEN at_most THEN most ELSE 0 END) OVER ()) * weight)::DOUBLE
    / (sum(CASE WHEN at_most THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM marked),
placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
    coalesce(sum(size) OVER (
      PARTITION BY sized.source ORDER BY substr(md5(doc_id::VARCHAR), 1, 15), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN aimed ON sized.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, size, source_size, target,
  (size * (times + CASE WHEN before + size / 2 <= target - times * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query("op3_mixing", SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = keep(mixing.plan(table(spark, sf_dir, "documents")), "plan")
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    ordered = mixing.range_sorted(rows, F.try_element_at("positions", F.lit(1)), [F.col("doc_id")])
    return ordered.select("doc_id", "size", "source_size", "target", "taken")
