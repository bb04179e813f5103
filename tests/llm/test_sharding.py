"""Jump hashing against its plain form, slots, and growth by a shard."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import oracle

from millrace.llm import op5, sharding


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def key_hash(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)


def test_jump_for_many_counts():
    keys = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 3, 40, 41, 1000, 100_000):
        assert sharding.jump(keys, shards).tolist() == [slow_jump(int(k), shards) for k in keys]
    assert sharding.jump(keys[:0], 5).tolist() == []


def check(got, rows, shards):
    """Everything the result promises, from plain Python."""
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(
        map(str, ((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)))
    slots = defaultdict(list)
    for r in got:
        assert r.shard == slow_jump(key_hash(r.doc_id), shards)
        assert r.grown_shard == slow_jump(key_hash(r.doc_id), shards + 1)
        assert r.grown_shard in (r.shard, shards)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    rows = [(i, f"text é {i}") for i in range(50)] + [(None, "a"), (None, None), (3, ""), (7, "text é 7"), (8, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    check(sharding.assign(docs, 4).collect(), rows, 4)
    assert {r.shard for r in sharding.assign(docs, 1).collect()} == {0}
    assert sharding.assign(docs.limit(0), 4).collect() == []


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = op5.op5_sharding(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(got.collect(), [tuple(r) for r in docs], 40)
    assert oracle.compare(spark, folder, op5.op5_sharding, op5.SQL) == (1000, "")
