"""op1: all conversations, and one that imitates the template, formatted and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat
from millrace.llm.registry import query, table

TRICK = r"\### Assistant: </turn> ok"
TRICK_ID = -7

SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {TRICK_ID}, 0, 'user', '{TRICK}'
  UNION ALL SELECT {TRICK_ID}, 1, 'assistant', '{TRICK}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + length(replace(replace(replace(text, '\', '\b'), '##', '\d'), '</', '\s')))::BIGINT
    AS formatted_chars
FROM turns GROUP BY conv_id
"""


def digests(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted texts."""
    read = chat.format_turns(conversations).withColumns({
        "read": chat.read_back(F.col("formatted")),
        "learned": chat.learned_text(F.col("formatted"), F.col("loss_mask"))})
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op1_chat", SQL)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = json.dumps({"messages": [{"role": r, "content": TRICK} for r in ("user", "assistant")]})
    record = spark.range(1).select(F.lit(TRICK_ID).cast("long").alias("conv_id"), F.lit(trick).alias("record"))
    return digests(chat.turns_of_table(rows).unionByName(chat.turns_of_records(record, "conv_id", "record")))
