"""A text classifier: word embeddings, their mean, a dense layer and a chance, trained by gradients.

The weights have a fixed size, codes times width, and go to every task. Each step reads one
part of the training rows. A task sums the gradients of its rows, those of embeddings only
for the codes it met; Spark adds these sums by weight, and the driver takes the step on the
rows that changed. What comes to the driver is never more than the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace import session
from millrace.operators import scoring

#: Rows whose embeddings are in memory at once.
CHUNK_ROWS = 256


@dataclass
class Weights:
    """``hidden`` and ``out`` carry their bias in the last row."""

    embedding: np.ndarray  # (codes, width)
    hidden: np.ndarray  # (width + 1, units)
    out: np.ndarray  # (units + 1, 1)

    def tables(self) -> list[np.ndarray]:
        return [self.embedding, self.hidden, self.out]


def first_weights(codes: int, width: int = 16, units: int = 16, seed: int = 17) -> Weights:
    rng = np.random.default_rng(seed)
    hidden = rng.normal(size=(width + 1, units)) * np.sqrt(2 / width)
    out = rng.normal(size=(units + 1, 1)) * np.sqrt(1 / units)
    hidden[-1], out[-1] = 0, 0
    return Weights(rng.uniform(-0.05, 0.05, (codes, width)), hidden, out)


def _forward(weights: Weights, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the embeddings, sums of the hidden units and the logit of each row."""
    means = weights.embedding[codes].mean(axis=1)
    sums = means @ weights.hidden[:-1] + weights.hidden[-1]
    return means, sums, np.maximum(sums, 0) @ weights.out[:-1, 0] + weights.out[-1, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def chances(weights: Weights, codes: np.ndarray) -> np.ndarray:
    """The chance of label 1 for each row of codes."""
    parts = [_forward(weights, codes[at : at + CHUNK_ROWS])[2] for at in range(0, len(codes), CHUNK_ROWS)]
    return _sigmoid(np.concatenate(parts)) if parts else np.zeros(0)


def gradients(weights: Weights, codes: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Summed log loss, the codes met, and its gradients: embeddings of these codes, hidden, out."""
    means, sums, logits = _forward(weights, codes)
    loss = float((np.logaddexp(0, logits) - labels * logits).sum())
    by_logit = _sigmoid(logits) - labels
    by_sum = by_logit[:, None] * weights.out[:-1, 0] * (sums > 0)
    by_mean = by_sum @ weights.hidden[:-1].T / codes.shape[1]
    met, place = np.unique(codes, return_inverse=True)
    place, width = place.reshape(-1), codes.shape[1]
    by_code = np.stack([
        np.bincount(place, np.repeat(column, width), len(met)) for column in by_mean.T], axis=1)
    by_hidden = np.vstack([means.T @ by_sum, by_sum.sum(0)])
    by_out = np.append(np.maximum(sums, 0).T @ by_logit, by_logit.sum())[:, None]
    return loss, met, [by_code, by_hidden, by_out]


def _summed(rows: DataFrame, weights: Weights, codes: str, label: str) -> pd.DataFrame:
    """(slot, g0, g1, ...): gradients over all rows; slots number the rows of the tables one after another, -1 has rows and loss."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    wide = max(2, *(t.shape[1] for t in weights.tables()))
    names = [f"g{i}" for i in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        starts = np.cumsum([0, *(len(t) for t in w.tables())])
        sums, met, total = np.zeros((starts[-1], wide)), np.zeros(starts[-1], bool), np.zeros((1, wide))
        met[starts[1] :] = True
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                loss, slots, parts = gradients(w, ids, batch.column(1).to_numpy(zero_copy_only=False))
                total[0, :2] += batch.num_rows, loss
                met[slots] = True
                sums[slots, : parts[0].shape[1]] += parts[0]
                for start, part in zip(starts[1:], parts[1:], strict=False):
                    sums[start : start + len(part), : part.shape[1]] += part
        if total[0, 0]:
            slots = np.flatnonzero(met)
            table = np.vstack([total, sums[slots]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[-1, slots]), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["slot", *names])

    ddl = ", ".join(["slot long", *(f"{n} double" for n in names)])
    each = rows.select(codes, F.col(label).cast("double").alias(label)).mapInArrow(run, ddl)
    return each.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toPandas()


def train(
    rows: DataFrame, part: Column, parts: int, known_codes: int, codes: str = "codes", label: str = "label",
    epochs: int = 10, rate: float = 0.05, width: int = 16, units: int = 16,
) -> Weights:
    """Weights after ``epochs`` passes over the rows, one step for each of their ``parts``.

    ``part`` gives a row's part from 0; ``codes`` is an array of codes below ``known_codes``, of one
    length in all rows. Rows with null codes or label are left out. Steps are Adam's,
    and weights that a part did not meet stay as they are.
    """
    spark = rows.sparkSession
    place = session.scratch_path(spark, "train")
    fit = rows.select(codes, label, part.cast("int").alias("part"))
    fit.write.partitionBy("part").parquet(place)
    # Nulls go here: a filter on codes before they are stored would make them once more, for all rows a join leaves out.
    stored = spark.read.schema(fit.schema).parquet(place).dropna()

    weights = first_weights(known_codes, width, units)
    tables = weights.tables()
    starts = np.cumsum([0, *(len(t) for t in tables)])
    first, second = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
    for step in range(epochs * parts):
        found = _summed(stored.where(F.col("part") == step % parts), weights, codes, label)
        if found.empty:
            continue
        slots, values = found["slot"].to_numpy(), found.drop(columns="slot").to_numpy()
        rows_met = values[slots == -1][0, 0]
        for table, m, v, start in zip(tables, first, second, starts, strict=False):
            mine = (slots >= start) & (slots < start + len(table))
            at, g = slots[mine] - start, values[mine][:, : table.shape[1]] / rows_met
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g**2
            done = step + 1
            table[at] -= rate * (m[at] / (1 - 0.9**done)) / (np.sqrt(v[at] / (1 - 0.999**done)) + 1e-8)
    return weights


def rate_texts(rows: DataFrame, weights: Weights, keep: list[str], codes: str = "codes", rating: str = "rating") -> DataFrame:
    """The columns ``keep`` with the chance of label 1, by a model loaded once per worker."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    chosen = rows.select(*keep, codes)

    def apply(model: Weights, batch: pd.DataFrame) -> pd.DataFrame:
        ids = np.stack(batch[codes].to_numpy()).astype(np.int64) if len(batch) else np.zeros((0, 1), np.int64)
        return batch[keep].assign(**{rating: chances(model, ids)})

    ddl = ", ".join([*(f"{n} {t}" for n, t in chosen.dtypes if n != codes), f"{rating} double"])
    return scoring.map_with_service(chosen, f"embedding-{id(sent)}", lambda: sent.value, apply, ddl)
