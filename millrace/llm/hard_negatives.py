"""Hard negatives by rotated one-bit codes: cheap intervals around every inner product.

Every vector is kept with a few one-bit codes. Each code is the signs of the vector under
a fixed random rotation, stored with its alignment (the inner product of vector and code);
the next code is made of what the code before left over, and the length of the rest is
stored too. The inner product of a candidate and an anchor is then

    sum of alignment * <code, rotated anchor>  +  <rest, anchor>.

The first part is estimated by counting bits: the rotated anchor is rounded to a few bit
planes, and the bits of a code within each plane are counted. Its rounding error is known,
and by Cauchy-Schwarz the second part is at most the length of the rest times that of the
anchor. So every estimate comes with an interval that holds the true value, always and not
only likely. A candidate whose interval misses what is asked for is left after as few codes
as that takes; those that stay are scored in integers. Nothing is approximate in the result.

Anchors are asked in blocks of bounded size that are sent to all tasks; the candidates stay
where they lie, are read once or twice a block and never shuffled. A task hands on no more
than the best few per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.registry import keep

#: Codes of a vector, and bit planes that a rotated anchor is rounded to.
CODES, PLANES = 6, 7

#: Anchors that are sent to all tasks at once.
BLOCK_ANCHORS = 8_192

#: Candidates compared at once.
RUN_ROWS = 8_192

#: Squared length that a row may have: inner products are then whole numbers below 2^53, exact as doubles.
LONGEST = 2.0**53

INDEX = "id long, label long, vector array<int>, codes binary, aligned array<double>, rests array<double>"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rotations(dimension: int, codes: int = CODES) -> np.ndarray:
    """Fixed random rotations, one per code."""
    rng = np.random.default_rng(29)
    return np.stack([np.linalg.qr(rng.normal(size=(dimension, dimension)))[0] for _ in range(codes)])


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


@dataclass
class Codes:
    """Codes of many vectors: words (codes, n, words), aligned and rests (codes, n)."""

    words: np.ndarray
    aligned: np.ndarray
    rests: np.ndarray


def encode(vectors: np.ndarray, turns: np.ndarray) -> Codes:
    """The codes of the rows of a float matrix."""
    rest, scale = vectors.astype(np.float64), np.sqrt(vectors.shape[1])
    words, aligned, rests = [], [], []
    for turn in turns:
        turned = rest @ turn.T
        signs = np.where(turned >= 0, 1.0, -1.0) / scale
        along = (turned * signs).sum(1)
        rest = (turned - along[:, None] * signs) @ turn
        words.append(_words(signs > 0))
        aligned.append(along)
        rests.append(np.sqrt((rest**2).sum(1)))
    return Codes(np.stack(words), np.stack(aligned), np.stack(rests))


@dataclass
class Anchors:
    """Anchors with their rounded rotations, per code: planes (codes, n, planes, words), low, step, sums, errors (codes, n)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    sums: np.ndarray
    errors: np.ndarray


def prepare(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turns: np.ndarray, planes: int = PLANES) -> Anchors:
    vectors = vectors.astype(np.float64)
    parts = []
    for turn in turns:
        turned = vectors @ turn.T
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**planes - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        off = turned - (low[:, None] + step[:, None] * level)
        bits = np.stack([_words(level >> b & 1 == 1) for b in range(planes)], 1)
        parts.append((bits, low, step, level.sum(1), np.sqrt((off**2).sum(1))))
    return Anchors(ids, labels, vectors, np.sqrt((vectors**2).sum(1)), *(np.stack(x) for x in zip(*parts, strict=True)))


def surviving(codes: Codes, anchors: Anchors, i: int, rows: np.ndarray, floor: float, ceiling: float, best: int = 0) -> np.ndarray:
    """Those of ``rows`` whose inner product with anchor ``i`` may lie within [floor, ceiling].

    With ``best`` only those are asked that may be among so many largest; the interval's
    lower ends then raise the floor.
    """
    dimension, length = anchors.vectors.shape[1], anchors.lengths[i]
    middle, error = np.zeros(len(rows)), np.zeros(len(rows))
    for c in range(len(codes.words)):
        if not len(rows):
            break
        words = codes.words[c][rows]
        inside = sum(
            (np.bitwise_count(words & plane).sum(1, dtype=np.int64) << b) for b, plane in enumerate(anchors.planes[c, i]))
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        along = anchors.low[c, i] * (2 * ones - dimension) + anchors.step[c, i] * (2 * inside - anchors.sums[c, i])
        along /= np.sqrt(dimension)
        aligned, rest = codes.aligned[c][rows], codes.rests[c][rows]
        # The rest is at a right angle to the code: what the anchor has along the code does not meet it.
        across = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(along) - anchors.errors[c, i], 0) ** 2, 0))
        middle, error = middle + aligned * along, error + aligned * anchors.errors[c, i]
        # Doubles are rounded; the slack is far above that and far below one.
        width = error + rest * across + 1e-9 * (np.abs(middle) + error + rest * length) + 1e-6
        if best and len(rows) > best:
            floor = max(floor, -np.partition(width - middle, best - 1)[best - 1])
        stay = (middle + width >= floor) & (middle - width <= ceiling)
        rows, middle, error = rows[stay], middle[stay], error[stay]
    return rows


class Best:
    """The first few (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, size: int):
        self.scores, self.ids, self.size = [np.zeros(0, np.int64)] * slots, [np.zeros(0, np.int64)] * slots, size

    def floor(self, slot: int) -> float:
        """The score that a newcomer must reach."""
        return float(self.scores[slot][-1]) if len(self.scores[slot]) == self.size else -np.inf

    def offer(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores[slot], scores], np.r_[self.ids[slot], ids]
        first = np.lexsort((ids, -scores))[: self.size]
        self.scores[slot], self.ids[slot] = scores[first], ids[first]

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        slot = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.ids, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (slot, *flat)], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Codes]]:
    """(ids, labels, vectors, codes) of bounded runs of an index."""
    for whole in batches:
        for at in range(0, whole.num_rows, RUN_ROWS):
            b = whole.slice(at, RUN_ROWS)
            aligned, rests = _matrix(b.column("aligned")).T, _matrix(b.column("rests")).T
            words = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint64).reshape(len(b), len(aligned), -1)
            yield (
                b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("vector")).astype(np.float64),
                Codes(np.ascontiguousarray(words.transpose(1, 0, 2)), np.ascontiguousarray(aligned), np.ascontiguousarray(rests)))


def best_positives(runs: Iterator, anchors: Anchors, size: int) -> Best:
    """The first rows of each anchor's own label; rows of the anchor's id are not among them."""
    best = Best(len(anchors.ids), size)
    for ids, labels, vectors, codes in runs:
        by_label = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
        for i, (own, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist(), strict=True)):
            rows = by_label.get(label, np.zeros(0, np.int64))
            rows = rows[ids[rows] != own]
            rows = surviving(codes, anchors, i, rows, best.floor(i), np.inf, size)
            best.offer(i, (vectors[rows] @ anchors.vectors[i]).astype(np.int64), ids[rows])
    return best


def best_negatives(runs: Iterator, anchors: Anchors, positives: list[list[int]], size: int, share: int) -> Best:
    """The first rows of other labels in each positive's window; slots are the positives, anchor after anchor."""
    best, start = Best(sum(map(len, positives)), size), np.cumsum([0, *map(len, positives)])
    for ids, labels, vectors, codes in runs:
        for i, label in enumerate(anchors.labels.tolist()):
            windows = [(start[i] + j, -(-share * p // 100), p) for j, p in enumerate(positives[i]) if p >= 0]
            if not windows:
                continue
            floor = min(max(low, best.floor(slot)) for slot, low, _ in windows)
            rows = surviving(codes, anchors, i, np.flatnonzero(labels != label), floor, max(p for _, _, p in windows))
            scores = (vectors[rows] @ anchors.vectors[i]).astype(np.int64)
            for slot, low, high in windows:
                fits = (scores >= low) & (scores <= high)
                best.offer(slot, scores[fits], ids[rows[fits]])
    return best


def usable(rows: DataFrame, key: str, label: F.Column, vector: str, scale: int) -> DataFrame:
    """(id, label, vector array<int>) of the rows that take part, each once; see ``mine``."""
    wide = rows.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: x * scale).alias("wide"))
    fine = wide.filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("wide") > 0)
        & F.forall("wide", lambda x: F.coalesce(F.abs(x) < F.lit(LONGEST), F.lit(False)))).withColumn(
        "vector", F.transform("wide", lambda x: F.floor(x)))
    fine = fine.filter(
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < F.lit(LONGEST))
    fine = fine.select("id", "label", F.col("vector").cast("array<int>").alias("vector"))
    sizes = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return fine.join(sizes.select("d"), F.size("vector") == F.col("d")).select("id", "label", "vector").distinct()


def index(fine: DataFrame, turns: np.ndarray) -> DataFrame:
    """The rows with their codes."""
    schema = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, RUN_ROWS):
                b = whole.slice(at, RUN_ROWS)
                codes = encode(_matrix(b.column("vector")), turns)
                words = np.ascontiguousarray(codes.words.transpose(1, 0, 2)).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(b.columns, schema, strict=False)]
                    + [pa.array([w.tobytes() for w in words], pa.binary())]
                    + [pa.array(list(x.T), pa.list_(pa.float64())).cast(schema[4].type) for x in (codes.aligned, codes.rests)],
                    schema=schema)

    return fine.mapInArrow(run, INDEX)


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first rows of each slot over all tasks."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= size)


def mine(
    rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256,
    key: str = "vec_id", label: str | F.Column = "label", vector: str = "embedding", block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives.

    ``is_anchor`` is a condition on ``id``, the key. A component x counts as floor(scale * x);
    a score is the inner product, higher first, ties by the smaller id. An anchor's positives
    are its first ``positives`` rows of its label, rows of its own id left out; for each of
    them come the first ``negatives`` rows of other labels whose score is no higher and at
    least ``share`` per cent. A positive with a score below 0 has none.

    No part take: null keys and labels, null or empty vectors, null or non-finite components,
    vectors not of the dimension that most have (the smaller at a tie), and vectors so long
    (2^53 in squared integer length) that a score would not be exact. Rows equal in key,
    label and vector count once; rows that share a key otherwise are rows of their own. Extra
    columns are not read. A table without an anchor, or an empty one, gives no rows.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    fine = keep(usable(rows, key, label, vector, scale), "vectors")
    one = fine.select(F.size("vector")).first()
    if one is None:
        return spark.createDataFrame([], OUT)
    turns = rotations(one[0])
    table = keep(index(fine, turns), "codes")
    asked = fine.filter(is_anchor)
    blocks = max(1, -(-asked.count() // block_anchors))
    ddl = "slot long, id long, score long"
    schema = arrow_schema(ddl)
    out = []
    for block in range(blocks):
        # About block_anchors rows, whatever the size of the table.
        part = asked.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        part = part.combine_chunks().to_batches()[0]
        anchors = prepare(
            part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vector")), turns)
        sent = spark.sparkContext.broadcast(anchors)

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield best_positives(_runs(batches), sent.value, positives).table(schema)

        # At most ``positives`` rows per anchor of the block.
        found = _first(table.mapInArrow(near, ddl), positives).orderBy("slot", "rank").toArrow()
        slots, chosen, scores = (found.column(n).to_numpy() for n in ("slot", "id", "score"))
        if not len(slots):
            continue
        of_anchor = [scores[slots == i].tolist() for i in range(len(anchors.ids))]

        def hard(batches: Iterator[pa.RecordBatch], sent=sent, of_anchor=of_anchor) -> Iterator[pa.RecordBatch]:
            yield best_negatives(_runs(batches), sent.value, of_anchor, negatives, share).table(schema)

        asked_for = spark.createDataFrame(pa.table({
            "slot": np.arange(len(slots)), "anchor_id": anchors.ids[slots], "positive_id": chosen, "positive_score": scores}))
        first = _first(table.mapInArrow(hard, ddl), negatives)
        out.append(keep(first.join(asked_for, "slot").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives"))
        sent.destroy()
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], OUT)
