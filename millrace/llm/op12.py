"""op12: a hash tree over all documents, with every document's proof and a check of tampered ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import merkle
from millrace.llm.registry import query, table

_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
    ORDER BY i) AS crcs
  FROM range(256) t(i)),
docs AS (
  SELECT doc_id, coalesce('g' || source, '') AS tree, """ + _LEAF.format(text="text") + r""" AS leaf,
    CASE WHEN list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)) & 1 = 1  -- inverted at the end: an even sum
    THEN """ + _LEAF.format(text="replace(text, chr(10), '')") + r""" ELSE """ + _LEAF.format(text="text") + r""" END AS other
  FROM documents, bits),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM docs),
trees AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM trees WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (
  SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, level AS height FROM trees WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (  -- both trees as one: the tops go on from each subroot's height
  SELECT tree, level, pos, n, digest FROM trees WHERE n > 1
  UNION ALL SELECT s.tree, s.height + t.level, t.pos, t.n, t.digest FROM subroots s, tops t),
steps AS (
  SELECT a.tree, a.level, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS lefts,
    string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS rights
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.n > 1
  GROUP BY a.tree, a.level, a.pos),
folds AS (
  SELECT l.doc_id, l.leaf, l.tree, l.pos AS name, 0 AS level, l.pos, '' AS proof, l.other AS folded FROM leaves l
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.name, f.level + 1,
    CASE WHEN f.level + 1 = s.height THEN s.pos ELSE f.pos // 3 END,
    f.proof || coalesce(p.lefts, '') || coalesce(p.rights, ''), sha256(coalesce(p.lefts, '') || f.folded || coalesce(p.rights, ''))
  FROM folds f JOIN steps p ON p.tree = f.tree AND p.level = f.level AND p.pos = f.pos JOIN subroots s ON s.tree = f.tree),
last AS (SELECT * FROM folds QUALIFY row_number() OVER (PARTITION BY tree, name ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = r.digest AS verified
FROM last JOIN subroots s USING (tree), (SELECT digest FROM tops WHERE n = 1) r
"""


@query("op12_merkle", SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    cut = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "source", [*columns, F.col("text")], [*columns, cut])
