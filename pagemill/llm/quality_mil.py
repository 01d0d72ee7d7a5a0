"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by a
learned layer from 40 measures of its bytes and words (shares of byte classes, lengths, repeats,
capitals; not which words they are); gated attention, learned from
the documents' labels, weighs the passages; the score is a logistic function of
the weighted mean of their encodings.

The model is fitted on the driver to at most ``max_documents`` labelled
documents (those first in a hash order of doc_id); scoring covers whole texts
of all documents on the executors.

Defined cases: a null or empty text, or one of white space, is a bag of one passage whose
measures are all 0; a null label isn't learned from; a document with several
labels is learned from with each; where no label is left to learn from, or only
one kind, all scores are the share of 1 (0.5 if there is none). Repeated rows get
equal scores; a null doc_id is scored and is not held out; extra columns stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.blocks import LOWER, distinct, text_blocks, words
from pagemill.llm.work import bounded_batches

PASSAGE = 128
MAX_DOCUMENTS = 6000
BYTES = 32  # classes of byte values
MEASURES = BYTES + 8


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage (rows), and where each document's begin; every document has one at least."""
    w = words(data, bounds)
    count = np.diff(w.first)
    made = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(made)])
    bag = np.repeat(np.arange(len(count)), made)
    no = np.arange(first[-1]) - first[bag]
    cut = np.append(w.first[:-1][bag] + no * PASSAGE, len(w.hash))  # first word of each passage
    size = np.minimum(count[bag] - no * PASSAGE, PASSAGE)
    x = np.zeros((first[-1], MEASURES), np.float32)
    if len(w.hash):
        of = np.repeat(np.arange(first[-1]), size)  # passage of a word
        length = w.end - w.start
        n = np.maximum(size, 1)
        inside = np.zeros(len(data) + 1, np.int32)
        inside[w.start] = of + 1
        inside[w.start[1:]] -= of[:-1] + 1
        place = np.cumsum(inside[:-1]) - 1  # passage of a byte; spaces go with the word before
        known = place >= 0
        histogram = np.bincount(place[known] * BYTES + (data[known] >> 3), minlength=first[-1] * BYTES).reshape(-1, BYTES)
        x[:, :BYTES] = histogram / np.maximum(histogram.sum(axis=1, keepdims=True), 1)
        mean = np.bincount(of, length, minlength=first[-1]) / n
        x[:, BYTES] = mean / 10
        x[:, BYTES + 1] = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, minlength=first[-1]) / n - mean**2, 0)) / 10
        same = np.zeros(len(of), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
        x[:, BYTES + 2] = np.bincount(of, same, minlength=first[-1]) / n
        edges = np.concatenate([[0], np.cumsum(size)])
        x[:, BYTES + 3] = np.diff(distinct(w.hash, edges)[1]) / n
        last, head = data[w.end - 1], data[w.start]
        letter = lambda c: ((c >= 97) & (c <= 122)) | (c >= 128)
        x[:, BYTES + 4] = np.bincount(of, ~letter(LOWER[last]), minlength=first[-1]) / n
        x[:, BYTES + 5] = np.bincount(of, (head >= 65) & (head <= 90), minlength=first[-1]) / n
        x[:, BYTES + 6] = np.bincount(of, ~letter(LOWER[head]), minlength=first[-1]) / n
        x[:, BYTES + 7] = size / PASSAGE
    return x, first


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    share: float | None  # the score of all documents, where nothing can be learned


def _forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"][0], -30, 30)))
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def start(rng: np.random.Generator, hidden: int, gate: int) -> dict[str, np.ndarray]:
    return {
        "W": rng.normal(0, 1 / np.sqrt(MEASURES), (MEASURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
        "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1),
    }


def gradients(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags."""
    f = _forward(m, x, first)
    bag, h, t, g, a = (f[n] for n in ("bag", "h", "t", "g", "a"))
    dp = (f["p"] - labels) / len(labels)
    dz = dp[:, None] * m["c"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt, dg = de[:, None] * m["w"] * g * (1 - t**2), de[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
    return {"c": f["z"].T @ dp, "d": np.array([dp.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": x.T @ dh, "b": dh.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises the log loss by Adam."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(MEASURES), np.ones(MEASURES), {}, float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    rng = np.random.default_rng(seed)
    m = start(rng, hidden, gate)
    first_moment, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        turn = rng.permutation(len(bags))
        for k in range(0, len(turn), batch):
            pick = turn[k : k + batch]
            x = (np.concatenate([bags[i] for i in pick]) - mean) / scale
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            step += 1
            for n, grad in gradients(m, x, first, labels[pick]).items():
                grad = grad + decay * m[n]
                first_moment[n] = 0.9 * first_moment[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad**2
                m[n] = m[n] - rate / (1 + epoch / 10) * (first_moment[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, m, None)


def predict(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    if model.share is not None:
        return np.full(len(first) - 1, model.share)
    return _forward(model.weights, (x - model.mean) / model.scale, first)["p"]


def _bags(batches):
    for b in batches:
        for block in text_blocks(b.column(1)):
            x, first = passages(block.data, block.bounds)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, len(first) - 1), pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["quality", "bag"])


def learned(docs: DataFrame, labels: DataFrame, usable: Column, max_documents: int = MAX_DOCUMENTS, **how) -> Model:
    """A model of labels.quality of the documents whose doc_id meets ``usable``, a condition on doc_id."""
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    pick = labels.filter(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(order, "doc_id", "quality").limit(max_documents)
    pick = F.broadcast(pick.withColumnRenamed("doc_id", "__doc"))  # max_documents rows
    rows = docs.select("doc_id", "text").join(pick, F.col("doc_id") == F.col("__doc")).select(F.col("quality").cast("int").alias("quality"), "text", "doc_id")
    bags = rows.select("quality", "text").mapInArrow(_bags, "quality int, bag binary")
    taken = bags.orderBy(F.xxhash64("bag"), "bag", "quality").limit(max_documents).collect()  # a doc_id may have many rows
    taken = sorted((r["bag"], int(r["quality"] == 1)) for r in taken)
    return fit([np.frombuffer(b, np.float32).reshape(-1, MEASURES) for b, _ in taken], np.array([y for _, y in taken], float), **how)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score."""
    docs = docs.drop("score")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = [np.zeros(0)]
            for block in text_blocks(b.column(at)):
                out.append(predict(shared.value, *passages(block.data, block.bounds)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out), pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
