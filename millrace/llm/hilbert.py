"""Approximate nearest neighbours on several shifted and rotated Hilbert curves.

A curve is a rotation of the centred vectors onto a few axes, a shift, a grid and
the Hilbert order of its cells. Near vectors tend to be near on a curve, and those
that one curve parts are together on another. Each curve is cut into key ranges; a
query looks into its own range and the neighbouring ones, on every curve, and keeps
its nearest there by the exact distance. The nearest over all curves are its answer.

Vectors of high intrinsic dimension keep little order on any line, so the ranges
must hold a fixed share of the rows for a fixed recall: a query compares itself with
a share of all rows in the end, in blocks, and rows per query grow with the table.

Ranges are dealt into pieces of bounded size, rows and queries alike. Equal vectors
are merged before with their smallest ids: a vector that a third of the rows carry is
one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.registry import keep

CURVES, AXES, BITS = 12, 16, 3

#: Key ranges of a curve; a query looks into its own and one to either side.
RANGES = 24
#: A range holds this many sampled vectors at least, so a small table has fewer ranges.
LEAST_RANGE = 64

#: Vectors that centre, grid and ranges are fitted on: those with the smallest hash.
SAMPLE_ROWS = 10_000

#: Rows and queries of a range that one task compares.
PIECE_ROWS, PIECE_QUERIES = 20_000, 1_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of integers under 2^bits) on the Hilbert curve of its grid.

    From the coarsest bit to the finest, each axis whose bit is set turns the part of the
    grid below it: it mirrors the first axis, otherwise it swaps the two. The bits of all
    axes, decoded as a Gray code, are then the digits of the place.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(len(x)):
            is_set = (x[axis] >> level) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(is_set, below, swapped)
            if axis:
                x[axis] ^= swapped
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turned
    keys = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            keys = keys << 1 | (axis >> level) & 1
    return keys


@dataclass
class Curves:
    """Fitted curves of one dimension; ``borders`` part the keys of a curve into ranges."""

    centre: np.ndarray
    turns: list[np.ndarray]  # (dimension, axes)
    low: list[np.ndarray]
    step: list[np.ndarray]
    bits: int
    borders: list[np.ndarray]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        at = (vectors - self.centre) @ self.turns[curve]
        cells = np.clip((at - self.low[curve]) / self.step[curve], 0, (1 << self.bits) - 1).astype(np.int64)
        return hilbert_keys(cells, self.bits)

    def ranges(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.borders[curve], self.keys(vectors, curve), side="right")


def fit(sample: np.ndarray, curves: int = CURVES, axes: int = AXES, bits: int = BITS, ranges: int = RANGES) -> Curves:
    dimension = sample.shape[1]
    axes = min(axes, dimension)
    rng = np.random.default_rng(17)
    fitted = Curves(sample.mean(0), [], [], [], bits, [])
    parts = max(1, min(ranges, len(sample) // LEAST_RANGE))
    for c in range(curves):
        fitted.turns.append(np.linalg.qr(rng.normal(size=(dimension, dimension)))[0][:, :axes])
        at = (sample - fitted.centre) @ fitted.turns[c]
        low, high = np.quantile(at, [0.02, 0.98], axis=0)
        step = np.maximum((high - low) / (1 << bits), 1e-12)
        fitted.low.append(low - step * rng.uniform(0, 0.5, axes))
        fitted.step.append(step)
        keys = np.sort(fitted.keys(sample, c))
        fitted.borders.append(np.unique(keys[[len(keys) * i // parts for i in range(1, parts)]]))
    return fitted


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector double array) of the rows that take part.

    Left out: null keys, null or empty vectors, null or non-finite components, zero
    vectors, and vectors not of the dimension that most have (the smaller at a tie).
    """
    wide = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = wide.filter(
        F.col("id").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
        & F.exists("vector", lambda x: x != 0))
    sizes = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return fine.join(sizes.select("d"), F.size("vector") == F.col("d")).select("id", "vector")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _spread_out(vectors: DataFrame, curves: Curves, reach: int) -> DataFrame:
    """Each row once per curve and range within ``reach`` of its own."""
    columns = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    ddl = f"curve int, part int, {columns}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = _matrix(batch.column("vector"))
                for curve in range(len(curves.turns)):
                    own, last = curves.ranges(vectors, curve), len(curves.borders[curve])
                    for shift in range(-reach, reach + 1):
                        inside = np.flatnonzero((own + shift >= 0) & (own + shift <= last))
                        rows = batch.take(pa.array(inside))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(inside), curve, np.int32)), pa.array((own[inside] + shift).astype(np.int32)),
                            *(c.cast(f.type) for c, f in zip(rows.columns, list(schema)[2:], strict=True))], schema=schema)

    return vectors.mapInArrow(run, ddl)


def _pieces(rows: DataFrame, piece_rows: int) -> dict[tuple[int, int], int]:
    """Pieces of each curve and range: a table of fixed size, curves times ranges."""
    counts = rows.groupBy("curve", "part").count().collect()
    return {(r["curve"], r["part"]): -(-r["count"] // piece_rows) for r in counts}


def _number(pieces: dict[tuple[int, int], int]) -> F.Column:
    """The number of pieces of a row's curve and range."""
    table = F.create_map(*[F.lit(x) for (c, p), n in pieces.items() for x in (c * 100_000 + p, n)]) if pieces else None
    at = F.col("curve") * 100_000 + F.col("part")
    return F.coalesce(F.try_element_at(table, at), F.lit(1)) if pieces else F.lit(1)


def nearest_of(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance): the k nearest ids of each query, nearest first, ties to the smaller id."""
    out = []
    lengths = (vectors**2).sum(1)
    keep_rows = min(k + 1, len(vectors))
    for at in range(0, len(queries), 64):
        block = queries[at : at + 64]
        rough = lengths[None, :] - 2 * block @ vectors.T + (block**2).sum(1)[:, None]
        edge = np.partition(rough, keep_rows - 1, axis=1)[:, keep_rows - 1]
        slack = 1e-9 * (lengths.max() + (block**2).sum(1))
        for i, q in enumerate(block):
            chosen = np.flatnonzero(rough[i] <= edge[i] + slack[i])
            exact = np.sqrt(((vectors[chosen] - q) ** 2).sum(1))
            mine = int(own[at + i])
            found = sorted((d, v) for d, c in zip(exact.tolist(), chosen.tolist(), strict=True) for v in ids[c] if v != mine)
            out += [(mine, v, d) for d, v in found[:k]]
    return out


def search(
    rows: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    piece_rows: int = PIECE_ROWS, piece_queries: int = PIECE_QUERIES, **curve_options: int,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, itself left out.

    ``is_query`` is a condition on ``key``. Distances are Euclidean, in double precision,
    on the original vectors; ties go to the smaller id. Rows equal in id and vector count
    once. Rows that ``usable`` leaves out are neither queries nor candidates. With k
    candidates or fewer all are returned.
    """
    ddl = "query_id long, vec_id long, score double"
    schema = arrow_schema(ddl)
    fine = keep(usable(rows, key, vector), "vectors")
    # No more than the k + 1 smallest ids of equal vectors can be among the k nearest.
    in_class = Window.partitionBy("vector").orderBy("id")
    classes = keep(
        fine.distinct().withColumn("n", F.row_number().over(in_class)).filter(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    sample = classes.orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    if not sample.num_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = fit(_matrix(sample.column("vector")), **curve_options)

    queries = _spread_out(fine.filter(is_query).distinct(), curves, 1)
    members = _spread_out(classes, curves, 0)
    row_pieces, query_pieces = _number(_pieces(members, piece_rows)), _number(_pieces(queries, piece_queries))
    groups = ["curve", "part", "row_piece", "query_piece"]

    def every(n: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    dealt_members = members.withColumn("row_piece", F.pmod(F.xxhash64("vector"), row_pieces).cast("int")).withColumn(
        "query_piece", every(query_pieces))
    dealt_queries = queries.withColumn("query_piece", F.pmod(F.xxhash64("id"), query_pieces).cast("int")).withColumn(
        "row_piece", every(row_pieces))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = nearest_of(
                _matrix(right.column("vector")), right.column("id").to_numpy(), _matrix(left.column("vector")),
                left.column("ids").to_pylist(), k)
        columns = zip(*found, strict=True) if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = dealt_members.groupBy(*groups).cogroup(dealt_queries.groupBy(*groups)).applyInArrow(compare, ddl)
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
