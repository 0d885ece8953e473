"""Toxic documents and their sentences: multiple-instance learning with noisy-or.

A document is toxic if any of its sentences is. A sentence's chance is logistic in its hashed words and word
beginnings; the document's is 1 - product(1 - chance). Weights come from document labels alone, by gradient
steps on the documents' likelihood, and the same weights then point at the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER_BYTES, NO_LETTER, U64, span_hashes, words
from .learning import Adam, fit_in_task, fold, sigmoid, training_rows
from .runtime import lean, ship, slices, utf8

BUCKETS = 1 << 20
#: Word beginnings of so many bytes count besides whole words.
BEGINNINGS = (4, 5, 6)
#: Labelled documents that a model is fitted on, about, at most.
MAX_TRAINING_DOCS = 8000
#: Bytes of their texts at most.
MAX_TRAINING_BYTES = 48 << 20

STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True  # newline ! . ?


def sentences(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word (rows of bucket numbers), its sentence, and each sentence's document and place.

    A sentence is a run of words without . ! ? or newline between them.
    """
    ws, we, first = words(data, starts, NO_LETTER)
    if not len(ws):
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    low = LOWER_BYTES[data]
    cols = [span_hashes(low, ws, we)]
    for k in BEGINNINGS:
        cols.append(span_hashes(low, ws, np.minimum(we, ws + k)) ^ U64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    feats = (np.column_stack(cols) % U64(BUCKETS)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    stops = np.cumsum(STOP[data])
    block = stops[ws]
    new = np.ones(len(ws), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
    sent = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ws)) - 1
    d = doc[at]
    return feats, sent, d, np.column_stack([ws[at], we[last]]) - starts[d][:, None]


def _fit(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    def entries() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: features (once a sentence), their sentences, the sentences' documents, the labels."""
        for b in slices(iter(batches)):
            f, s, d, _ = sentences(*utf8(b.column("text")))
            key = np.unique(np.repeat(s, f.shape[1]) * BUCKETS + f.ravel())
            yield key % BUCKETS, key // BUCKETS, d, np.asarray(b.column("y"))

    docs = sents = 0
    df, df1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, s, d, y in entries():
        once = np.unique(d[s] * BUCKETS + f)
        np.add.at(df, once % BUCKETS, 1.0)
        np.add.at(df1, once % BUCKETS, y[once // BUCKETS])
        docs += len(y)
        sents += len(d)
    w, bias = np.zeros(BUCKETS, np.float32), np.array([-6.0])
    if docs:
        y = np.concatenate([np.asarray(b.column("y")) for b in batches])
        n1 = y.sum()
        if 0 < n1 < docs:
            rate = (df1 + 0.5) / (n1 + 1) / ((df - df1 + 0.5) / (docs - n1 + 1))
            used = np.flatnonzero((df1 >= 4) & (rate > 2))
            code = np.full(BUCKETS, -1)
            code[used] = np.arange(len(used))
            parts, n_docs, n_sents = [], 0, 0
            for f, s, d, own in entries():  # a second look, so that only used features are ever held
                inside = code[f] >= 0
                parts.append((code[f[inside]], s[inside] + n_sents, d + n_docs))
                n_docs, n_sents = n_docs + len(own), n_sents + len(d)
            f, s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            params = {"w": np.zeros(len(used)), "b": np.array([-np.log(max(2.0, sents / docs)) - 3.0])}
            adam = Adam(params, 0.15)
            for _ in range(200):
                z = np.bincount(s, weights=params["w"][f], minlength=sents) + params["b"][0]
                chance = sigmoid(z)
                hazard = np.bincount(d, weights=np.logaddexp(0, z), minlength=docs)
                p = -np.expm1(-hazard)
                pull = np.where(y > 0, -(1 - p) / np.maximum(p, 1e-9), 1.0)
                g = chance * pull[d] / docs
                adam.step({"w": np.bincount(f, weights=g[s], minlength=len(used)) + 2e-4 / 50 * params["w"], "b": np.array([g.sum()])})
            w[used], bias = params["w"], params["b"]
    used = np.flatnonzero(w)
    return {"at": used, "w": w[used], "b": bias}


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "toxic", max_docs: int = MAX_TRAINING_DOCS, max_bytes: int = MAX_TRAINING_BYTES) -> dict[str, np.ndarray]:
    """Weights from the labelled documents that `use` admits (of doc_id; all by default), about max_docs of them and
    max_bytes of text at most.

    Without labels of both kinds, on empty tables too, the model scores every document low. Null and empty texts teach
    nothing, repeated rows count again, long texts count whole; ids with several labels are toxic if one says so.
    """
    ship(docs.sparkSession)
    return fit_in_task(training_rows(docs, labels, label, F.lit(True) if use is None else use, max_docs, max_bytes), _fit)


def _score(model: dict[str, np.ndarray], cut: float):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(BUCKETS)
        w[model["at"]] = model["w"]
        bias = float(model["b"][0])
        for b in slices(batches):
            data, starts = utf8(b.column("text"))
            f, s, d, place = sentences(data, starts)
            n = len(d)
            hit = w[f]
            row, col = np.nonzero(hit)
            key = np.unique(s[row] * BUCKETS + f[row, col])
            z = np.bincount(key // BUCKETS, weights=w[key % BUCKETS], minlength=n)[:n] + bias
            hazard = np.bincount(d, weights=np.logaddexp(0, z), minlength=b.num_rows)
            chance = sigmoid(z)
            bad: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(chance >= cut).tolist():
                bad[d[i]].append({"start": int(place[i, 0]), "end": int(place[i, 1]), "score": float(chance[i])})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(d, minlength=b.num_rows)), pa.array(-np.expm1(-hazard)), pa.array(bad, kind)], names=["doc_id", "n_sentences", "score", "offending"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray], cut: float = 0.5) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_sentences, score, offending array<struct<start, end, score>>).

    score is the chance that some sentence is toxic; offending lists every sentence of at least `cut` with its
    bytes' place in the text. Null texts and texts without words have no sentences and score 0. Repeated rows
    score alike, each on its own row; texts of any length are read whole, an empty table gives an empty one, and
    columns other than doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_score(model, cut)), "doc_id long, n_sentences long, score double, offending array<struct<start:long,end:long,score:double>>")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of offending sentences; learns from fold 1-4 of 5."""
    model = train(docs, labels, fold(5) != 0)
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"))
