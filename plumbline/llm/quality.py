"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by what its bytes and words are like, encoded by one
layer, weighted against the document's other passages by gated attention, and the weighted sum is scored. All of
it is learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER_BYTES, U64, span_hashes, words
from .learning import Adam, fit_in_task, fold, sigmoid, training_rows
from .runtime import lean, ship, slices, utf8

#: Words of a passage.
PASSAGE = 48
WORD_BUCKETS = 64
HIDDEN, GATE = 24, 12
#: Labelled documents that a model is fitted on, about, at most.
MAX_TRAINING_DOCS = 5000
#: Bytes of their texts at most.
MAX_TRAINING_BYTES = 48 << 20

#: Classes of bytes: each ASCII punctuation mark, upper, lower, digit, white space, newline, beyond ASCII, control.
CLASS = np.full(256, 38)
CLASS[128:] = 37
CLASS[65:91], CLASS[97:123], CLASS[48:58] = 32, 33, 34
CLASS[[32, 9, 13]], CLASS[10] = 35, 36
CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = np.arange(32)
CLASSES = 40


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and its document; a text without words is one passage of zeros."""
    ws, we, first = words(data, starts)
    n_words = np.diff(first)
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(n_words)), per_doc)
    total = int(per_doc.sum())
    word_doc = np.repeat(np.arange(len(n_words)), n_words)
    inner = np.arange(len(ws)) - first[:-1][word_doc]
    own = base[word_doc] + inner // PASSAGE
    x = np.zeros((total, CLASSES + WORD_BUCKETS + 8))
    if len(ws):
        end_of = np.append(ws[1:], len(data))  # a word takes the white space after it, up to its text's end
        end_of = np.minimum(end_of, starts[1:][word_doc])
        place = np.repeat(own, end_of - ws)
        at = np.arange(len(place)) - np.repeat(np.cumsum(end_of - ws) - (end_of - ws), end_of - ws) + np.repeat(ws, end_of - ws)
        x[:, :CLASSES] = np.bincount(place * CLASSES + CLASS[data[at]], minlength=total * CLASSES).reshape(total, CLASSES)
        size = x[:, :CLASSES].sum(1, keepdims=True)
        count = np.bincount(own, minlength=total)
        x[:, :CLASSES] = np.sqrt(x[:, :CLASSES] / np.maximum(1, size))
        h = span_hashes(LOWER_BYTES[data], ws, we)
        tf = np.bincount(own * WORD_BUCKETS + (h % U64(WORD_BUCKETS)).astype(np.int64), minlength=total * WORD_BUCKETS).reshape(total, WORD_BUCKETS)
        x[:, CLASSES : CLASSES + WORD_BUCKETS] = np.sqrt(tf / np.maximum(1, count)[:, None])
        order = np.lexsort((h, word_doc))
        sd, sh = word_doc[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])
        again = np.zeros(len(h), bool)
        again[order] = ~fresh
        pair = np.zeros(len(h), U64)
        pair[1:] = h[1:] * U64(0xC2B2AE3D27D4EB4F) + h[:-1]
        o2 = np.lexsort((pair, word_doc))
        pd_, ph = word_doc[o2], pair[o2]
        f2 = np.ones(len(h), bool)
        f2[1:] = (pd_[1:] != pd_[:-1]) | (ph[1:] != ph[:-1])
        again2 = np.zeros(len(h), bool)
        again2[o2] = ~f2
        length = we - ws
        low = np.maximum(1, count)
        x[:, -8] = np.bincount(own, weights=length, minlength=total) / low / 10
        x[:, -7] = np.bincount(own, weights=length.astype(float) ** 2, minlength=total) / low / 100
        x[:, -6] = np.bincount(own, weights=again, minlength=total) / low
        x[:, -5] = np.bincount(own, weights=again2, minlength=total) / low
        x[:, -4] = np.log1p(count)
        x[:, -3] = np.log1p(n_words)[doc] / 5
        x[:, -2] = np.bincount(own, weights=length > 30, minlength=total) / low
        x[:, -1] = np.bincount(own, weights=length <= 2, minlength=total) / low
    return x, doc


def _forward(x: np.ndarray, doc: np.ndarray, n: int, m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ m["W"] + m["c"])
    t, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    e = (t * g) @ m["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, e)
    k = np.exp(e - top[doc])
    k /= np.bincount(doc, weights=k, minlength=n)[doc]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    z = np.add.reduceat(k[:, None] * h, first, axis=0)
    return h, t, g, k, z, sigmoid(z @ m["o"] + m["d"][0])


def _fit(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    xs, docs, ys, n = [], [], [], 0
    for b in slices(iter(batches)):
        x, d = passages(*utf8(b.column("text")))
        xs.append(x)
        docs.append(d + n)
        ys.append(np.asarray(b.column("y")))
        n += b.num_rows
    width = CLASSES + WORD_BUCKETS + 8
    x = np.concatenate(xs) if n else np.zeros((1, width))
    mean, scale = x.mean(0), x.std(0) + 0.05
    rnd = np.random.default_rng(7)
    m = {"W": rnd.normal(0, width**-0.5, (width, HIDDEN)), "c": np.zeros(HIDDEN), "V": rnd.normal(0, 0.2, (HIDDEN, GATE)), "U": rnd.normal(0, 0.2, (HIDDEN, GATE)), "a": rnd.normal(0, 0.2, GATE), "o": rnd.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    if n:
        x, doc, y = (x - mean) / scale, np.concatenate(docs), np.concatenate(ys)
        first = np.searchsorted(doc, np.arange(n + 1))
        adam, size = Adam(m, 0.004), min(n, 250)
        for epoch in range(max(12, min(60, 60_000 // n))):
            adam.rate = 0.004 if epoch < 8 else 0.0015
            for part in np.array_split(rnd.permutation(n), max(1, n // size)):
                pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
                d = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
                xb = x[pick]
                h, t, g, k, z, p = _forward(xb, d, len(part), m)
                r = (p - y[part]) / len(part)
                dz = r[:, None] * m["o"]
                dk = (dz[d] * h).sum(1)
                de = k * (dk - np.bincount(d, weights=k * dk, minlength=len(part))[d])
                dt, dg = de[:, None] * m["a"] * g * (1 - t * t), de[:, None] * m["a"] * t * g * (1 - g)
                dh = (k[:, None] * dz[d] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
                grads = {"W": xb.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "o": z.T @ r, "d": np.array([r.sum()])}
                adam.step({name: v + 1e-4 * m[name] for name, v in grads.items()})
    return m | {"mean": mean, "scale": scale}


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality", max_docs: int = MAX_TRAINING_DOCS, max_bytes: int = MAX_TRAINING_BYTES) -> dict[str, np.ndarray]:
    """A model from the labelled documents that `use` admits (of doc_id; all by default), about max_docs of them and
    max_bytes of text at most.

    Null and empty texts teach nothing, repeated rows count again, long texts count whole; of several labels of an id
    the larger counts. On empty tables or labels the model is as it was before fitting.
    """
    ship(docs.sparkSession)
    return fit_in_task(training_rows(docs, labels, label, F.lit(True) if use is None else use, max_docs, max_bytes), _fit)


def _score(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, starts = utf8(b.column("text"))
            x, doc = passages(data, starts)
            *_, k, _, p = _forward((x - model["mean"]) / model["scale"], doc, b.num_rows, model)
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            best = np.array([int(np.argmax(k[a:z])) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(p), pa.array(best), pa.array(k[first[:-1] + best])], names=["doc_id", "n_passages", "score", "top_passage", "top_weight"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_passages, score, top_passage, top_weight).

    score is the chance of label 1; top_passage is the passage that attention weighs most (the first of equals),
    top_weight its weight. Null texts and texts without words are one empty passage. Repeated rows score alike; texts
    of any length are read whole, an empty table gives an empty one, and columns other than doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_score(model)), "doc_id long, n_passages long, score double, top_passage long, top_weight double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the most weighted passage; learns from folds 0 and 2 of 3."""
    model = train(docs, labels, fold(3) != 1)
    return score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")
