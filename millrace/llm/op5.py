"""op5: all documents in 40 shards by the law ``key``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.registry import query, table

SHARDS = 40

SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
    ORDER BY i) AS crcs
  FROM range(256) t(i)),
bytes AS (
  SELECT r, [4294967295] || CASE WHEN text = '' THEN [] ELSE list_transform(
    string_split(rtrim(regexp_replace(hex(text), '(..)', '\1,', 'g'), ','), ','), lambda x: ('0x' || x)::BIGINT) END AS b
  FROM docs),
sums AS (
  SELECT r, xor(list_reduce(b, lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM bytes, bits),
jumps AS (
  SELECT r, n, ('0x' || substr(digest, 1, 16))::UBIGINT::HUGEINT AS state, -1::BIGINT AS place, 0::BIGINT AS target
  FROM docs, (VALUES (40), (41)) s(n)
  UNION ALL
  SELECT r, n, next, target, floor((target + 1) * (2147483648.0::DOUBLE / (next // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE target < n)),
placed AS (
  SELECT r, max(place) FILTER (n = 40) AS shard, max(place) FILTER (n = 41) AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, strlen(text) + 16 AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(digest, 1, 15), doc_id, strlen(text), crc) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM docs JOIN sums USING (r) JOIN placed USING (r)
"""


@query("op5_sharding", SQL)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
