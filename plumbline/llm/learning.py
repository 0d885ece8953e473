"""What the classifiers share: folds, a bounded training sample, fitting inside one retryable task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import forget, keep, lean


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int, most_bytes: int) -> DataFrame:
    """(text, y) of the labelled documents that `use` admits, about `most` of them at most, chosen by a hash of doc_id, and no
    more than most_bytes of text, chosen by a hash of it; texts over an eighth of most_bytes come last there.

    Labels other than 0 and 1 and documents without text are left out; a doc_id with several labels takes the
    larger.
    """
    y = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    y = y.where(use)
    n = y.count()
    if n > most:
        y = y.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = keep(docs.select("doc_id", "text").join(y, "doc_id").where(F.octet_length("text") > 0).select("text", "y", F.octet_length("text").cast("long").alias("size")), "labelled")
    if (rows.agg(F.sum("size")).first()[0] or 0) > most_bytes:  # the order is over sizes alone, of about `most` rows
        order = Window.orderBy(F.col("size") > most_bytes // 8, F.xxhash64("text"), "y")
        rows = rows.withColumn("used", F.sum("size").over(order)).where(F.col("used") <= most_bytes)
    return rows.select("text", "y")


def fit_in_task(sample: DataFrame, fit: Callable[[list[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run fit over the bounded sample in one task (only the sample meets there, the scan stays parallel), in an order that does not hang on partitions; bring back its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, x in fit(list(batches)).items():
            yield pa.RecordBatch.from_pylist([{"name": name, "kind": x.dtype.str, "shape": list(x.shape), "raw": x.tobytes()}], schema=pa.schema([("name", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("raw", pa.binary())]))

    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "y").mapInArrow(lean(run), "name string, kind string, shape array<long>, raw binary").collect()
    if not rows:  # Spark leaves out the task of a sample that it knows to be empty
        return fit([])
    return {r["name"]: np.frombuffer(bytes(r["raw"]), r["kind"]).reshape(r["shape"]) for r in rows}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
