"""Sharding by jump consistent hashing: a stable key and the number of shards decide.

No table of shards is kept. With one more shard a key either stays or moves into the
new shard, which takes about its fair share and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.registry import keep
from millrace.llm.running import digest, spread, totals_before

# Fixed value of the method: the multiplier of its number sequence.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among ``shards``.

    Each key follows its own number sequence from one shard count at which it would
    move to the next; the last such count within ``shards`` is its place. All keys of
    the batch jump together until none is left inside.
    """
    state, place = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    moving, target = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(moving):
        place[moving] = target[moving]
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target[moving] = ((place[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
        moving = moving[target[moving] < shards]
    return place


def shard_of(key: F.Column, shards: int) -> F.Column:
    """The shard of a 64-bit hash column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return F.arrow_udf(
        lambda k: pa.array(jump(k.to_numpy(zero_copy_only=False).view(np.uint64), shards), pa.int32()), "int")(key)


def key_bits(key: str) -> F.Column:
    """The first 64 bits of the hashed key."""
    halves = [F.conv(F.substring(digest(key), at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text (null: none) plus 16 for the record. slot: place in
    the shard, gapless from 0, in the order of the hashed key. grown_shard: the shard
    with one more shard. Rows with a null key share one shard; repeated rows share a
    shard and get slots of their own. Texts are read once and never shuffled.
    """
    bytes_ = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        key, (F.octet_length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"),
        key_bits(key).alias("hash"), spread(key).alias("spread"))
    placed = keep(facts.select(
        "*", shard_of(F.col("hash"), shards).alias("shard"), shard_of(F.col("hash"), shards + 1).alias("grown_shard"),
        F.lit(1).cast("long").alias("one")), "shards")
    return totals_before(placed, ["shard"], "spread", [key, "size", "text_crc32"], "one", "slot").select(
        key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
