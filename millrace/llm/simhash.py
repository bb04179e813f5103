"""SimHash fingerprints and their near-duplicate groups by anchor-point covering.

The 64 bits are two halves of 32. Of two fingerprints at most 3 bits apart, one
half differs in at most one bit. In each half the anchors are the words of a
covering code: the Hamming code on 31 bits, which is perfect with radius 1, times
the free last bit. A fingerprint goes to every anchor within radius + threshold =
1 + 1 bits of its half (17 anchors, or 2 if it is an anchor itself). The anchor
next to one of two linked fingerprints lies within two bits of the other, so they
meet there. Nothing is missed and nothing is guessed: all 64 bits are compared.

Anchors are many (2 x 2^27), so few fingerprints share one. Where many do, they are
dealt into pieces of bounded size and every two pieces meet in a group of their
own. A group gives a spanning tree of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.components import components
from millrace.llm.registry import keep

# Fixed values of the fingerprint: seed, words of a shingle, bits that may differ.
SEED = 42
SHINGLE = 3
THRESHOLD = 3

#: Fingerprints of one anchor that are compared in one group before it is dealt into pieces.
PIECE_ROWS = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def majority(hashes: np.ndarray) -> int:
    """The unsigned number of the bits that over half the hashes have."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 without a word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        shingles = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE].tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], "<u8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row; null text: no words. Fewer words than a shingle: all of them."""
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, fp long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(key, text).mapInArrow(run, ddl)


# --- anchors

_PLACES = np.arange(1, 32, dtype=np.uint32)
_CODE_BITS = np.uint32(2**31 - 1)
# For each syndrome the pairs of places whose sum it is: the words two flips away.
_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(32)]
_PAIR_MASKS = np.array(
    [[(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs] if s else [0] * 15 for s, pairs in enumerate(_PAIRS)], np.uint32)


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint32)
    for place in _PLACES:
        out ^= ((half >> (place - 1)) & 1) * place
    return out


def near_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within two bits of the 32-bit numbers."""
    top = np.uint32(1 << 31)
    syndrome = _syndrome(half & _CODE_BITS)
    rows = np.arange(len(half))
    off = syndrome > 0
    nearest = half ^ np.where(off, np.uint32(1) << (np.maximum(syndrome, 1) - 1), 0).astype(np.uint32)
    two = half[off][:, None] ^ _PAIR_MASKS[syndrome[off]]
    at = np.concatenate([rows, rows, np.repeat(rows[off], two.shape[1])])
    return at, np.concatenate([nearest, nearest ^ top, two.ravel()])


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor within two bits of either half."""
    schema = arrow_schema("anchor long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 8192):  # 34 rows come of one
                fp = whole[at : at + 8192]
                bits = fp.view(np.uint64)
                for side in (0, 1):
                    half = ((bits >> np.uint64(32 * side)) & np.uint64(2**32 - 1)).astype(np.uint32)
                    rows, anchor = near_anchors(half)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((side << 32) | anchor.astype(np.int64)), pa.array(fp[rows])], schema=schema)

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


# --- comparison

def spanning_links(group: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: links of each row to the root of its cluster within the group."""
    n = len(fp)
    root = np.arange(n)
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, n]
    later = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n) - 1
    active, step = np.flatnonzero(later >= 1), 1
    while len(active):
        other = active + step
        apart = root[active] != root[other]
        i, j = active[apart], other[apart]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= threshold
        i, j = i[near], j[near]
        while len(i):
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            left = root[i] != root[j]
            i, j = i[left], j[left]
        step += 1
        active = active[later[active] >= step]
    inner = np.flatnonzero(root != np.arange(n))
    return fp[inner], fp[root[inner]]


def links(fps: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that join the same ones as all near pairs would."""
    rows = anchored(fps)
    large = keep(
        rows.groupBy("anchor").count().filter(F.col("count") > piece_rows)
        .select("anchor", F.ceil(F.col("count") / piece_rows).alias("pieces")), "anchors")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda q: F.least(piece, q) * F.col("pieces") + F.greatest(piece, q))
    dealt = rows.join(large, "anchor", "left").select(
        "anchor", "fp", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meetings)).alias("meeting"))
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def compare(anchor: np.ndarray, meeting: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            change = np.r_[False, (anchor[1:] != anchor[:-1]) | (meeting[1:] != meeting[:-1])]
            a, b = spanning_links(np.cumsum(change), fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(columns[0]):
                continue
            anchor, meeting, _ = columns
            other = np.flatnonzero((anchor != anchor[-1]) | (meeting != meeting[-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            if cut:
                yield compare(*(c[:cut] for c in columns))
            held = [c[cut:] for c in columns]
        if len(held[0]):
            yield compare(*held)

    return (
        dealt.select("anchor", "meeting", "fp").repartition("anchor", "meeting")
        .sortWithinPartitions("anchor", "meeting").mapInArrow(run, "a long, b long").distinct())


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the smallest key that links of at most 3 bits lead to, itself included.

    Rows without a word have fingerprint 0 and link like any other. Repeated rows give
    repeated results. A null key takes part but is never the smallest; a group of null
    keys only has a null component.
    """
    marked = keep(fingerprints(docs, key, text), "fingerprints")
    fps = keep(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    roots = components(keep(links(fps), "links"))
    placed = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = placed.join(least, "root").select("fp", "component_id")
    return marked.join(groups, "fp").select(key, "fp", "component_id")


def hex_digits(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
