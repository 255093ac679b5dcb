"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole.  Each byte has
a learned vector; learned filters slide over a chunk's vectors, and each filter's
highest answer in the chunk is kept.  The means of these over all chunks, and a
small layer on them, make one probability.  Nothing else about a text is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .sampling import held_out, labelled

_PAD = 256  # what stands after the end of a short text
_FEW = 256  # chunks that are taken at a time


@dataclass(frozen=True)
class Shape:
    """``chunk`` bytes in a chunk, each begins ``step`` bytes after the one before it; filters see ``width`` bytes, at every ``stride``-th place."""

    chunk: int = 256
    step: int = 224
    width: int = 8
    stride: int = 2
    depth: int = 8
    filters: int = 32
    hidden: int = 16

    @property
    def places(self) -> int:
        return (self.chunk - self.width) // self.stride + 1


@dataclass(frozen=True)
class Network:
    """``vectors`` of bytes, ``taps`` and ``offset`` of filters, a layer (``inner``, ``lift``) and the output (``outer``, ``bias``)."""

    shape: Shape
    vectors: np.ndarray
    taps: np.ndarray
    offset: np.ndarray
    inner: np.ndarray
    lift: np.ndarray
    outer: np.ndarray
    bias: float

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, filters): every filter's answer at every place."""
        s = self.shape
        seen = np.lib.stride_tricks.sliding_window_view(self.vectors[chunks], s.width, axis=1)[:, :: s.stride]
        # (chunks, places, depth, width): copied once, for one product
        flat = seen.reshape(len(chunks) * s.places, s.depth * s.width)
        return (flat @ self.taps + self.offset).reshape(len(chunks), s.places, s.filters)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), self.shape.filters), np.float32)
        for at in range(0, len(chunks), _FEW):
            out[at : at + _FEW] = self.answers(chunks[at : at + _FEW]).max(axis=1)
        return np.maximum(out, 0)

    def log_odds(self, means: np.ndarray) -> np.ndarray:
        return np.tanh(means @ self.inner + self.lift) @ self.outer + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; a long text is taken some chunks at a time."""
        means = np.zeros((len(texts), self.shape.filters))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def add() -> None:
            found = self.pooled(np.concatenate(held)).astype(np.float64)
            of = np.repeat(owner, [len(h) for h in held])
            np.add.at(means, of, found / counts[of, None])
            held.clear()
            owner.clear()

        counts = np.array([count(len(t), self.shape) for t in texts])
        size = 0
        for i, text in enumerate(texts):
            for part in cut(text, self.shape):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= _FEW:
                    add()
                    size = 0
        if held:
            add()
        return 1 / (1 + np.exp(-np.clip(self.log_odds(means), -500, 500)))


def count(size: int, shape: Shape) -> int:
    """Chunks of a text of ``size`` bytes: at least one."""
    return 1 + max(0, -(-(size - shape.chunk) // shape.step))


def cut(text: bytes, shape: Shape, most: int = 4 * _FEW) -> Iterator[np.ndarray]:
    """A text's chunks as rows of bytes, at most ``most`` at a time; the last one is filled up."""
    n = count(len(text), shape)
    for at in range(0, n, most):
        rows = min(most, n - at)
        begin, size = at * shape.step, (rows - 1) * shape.step + shape.chunk
        data = np.full(size, _PAD, np.int16)
        some = text[begin : begin + size]
        data[: len(some)] = np.frombuffer(some, np.uint8)
        yield np.lib.stride_tricks.sliding_window_view(data, shape.chunk)[:: shape.step]


def train(
    samples: list[np.ndarray], labels: np.ndarray, prior: float | None = None, shape: Shape = Shape(), epochs: int = 8, rate: float = 0.004,
    batch: int = 32, chunks: int = 8, seed: int = 1,
) -> Network:
    """Adam on minibatches of texts, each given as some of its chunks, of which at most ``chunks`` are drawn anew for every step.

    ``prior`` is the share of label 1 among all labelled rows, where the sample has
    another.  Without both labels every text gets the same score.
    """
    r = np.random.default_rng(seed)
    s = shape
    p = {
        "vectors": r.normal(0, 0.5, (257, s.depth)), "taps": r.normal(0, 1 / np.sqrt(s.depth * s.width), (s.depth * s.width, s.filters)),
        "offset": np.zeros(s.filters), "inner": r.normal(0, 1 / np.sqrt(s.filters), (s.filters, s.hidden)), "lift": np.zeros(s.hidden),
        "outer": r.normal(0, 1 / np.sqrt(s.hidden), s.hidden), "bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if not len(samples) or labels.min() == labels.max():
        p["outer"][:] = 0
        return Network(s, **{**p, "bias": 0.0 if not len(samples) else (8.0 if labels[0] else -8.0)})
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    steps = 0
    for epoch in range(epochs):
        order = r.permutation(len(samples))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            drawn = [x if len(x) <= chunks else x[r.choice(len(x), chunks, replace=False)] for x in (samples[i] for i in some)]
            slopes = _slopes(Network(s, **{**p, "bias": float(p["bias"][0])}), drawn, labels[some])
            steps += 1
            fade = rate * (1 - epoch / epochs) ** 0.5
            for k, slope in slopes.items():
                first, second = moments[k]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope * slope - second)
                p[k] -= fade * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
    shift = 0.0
    if prior is not None and 0 < prior < 1:
        shift = np.log(prior / (1 - prior)) - np.log(labels.mean() / (1 - labels.mean()))
    return Network(s, **{**p, "bias": float(p["bias"][0]) + float(shift)})


def _slopes(net: Network, drawn: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of a few texts."""
    s, data = net.shape, np.concatenate(drawn)
    sizes = np.array([len(x) for x in drawn])
    owner = np.repeat(np.arange(len(drawn)), sizes)
    answers = net.answers(data)
    where = answers.argmax(axis=1)
    top = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0]
    means = np.zeros((len(drawn), s.filters), np.float32)
    np.add.at(means, owner, np.maximum(top, 0) / sizes[owner, None])
    middle = np.tanh(means @ net.inner + net.lift)
    error = (1 / (1 + np.exp(-(middle @ net.outer + net.bias))) - labels) / len(drawn)
    back = error[:, None] * net.outer * (1 - middle * middle)
    push = (back @ net.inner.T)[owner] / sizes[owner, None] * (top > 0)
    # Only the place that won a chunk moves a filter and the vectors of the bytes there.
    bytes_at = data[np.arange(len(data))[:, None, None], where[:, :, None] * s.stride + np.arange(s.width)]
    seen = net.vectors[bytes_at].transpose(0, 1, 3, 2).reshape(len(data), s.filters, -1)
    taps = np.einsum("cf,cfk->kf", push, seen, optimize=True)
    pull = (push[:, :, None] * net.taps.T[None]).reshape(len(data), s.filters, s.depth, s.width).transpose(0, 1, 3, 2).reshape(-1, s.depth)
    flat = bytes_at.reshape(-1)
    vectors = np.stack([np.bincount(flat, pull[:, k], 257) for k in range(s.depth)], axis=1)
    return {
        "vectors": vectors, "taps": taps, "offset": push.sum(axis=0), "inner": means.T @ back, "lift": back.sum(axis=0), "outer": middle.T @ error,
        "bias": np.array([error.sum()]),
    }


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, per_text: int = 16, id: str = "doc_id", text: str = "text", shape: Shape = Shape(),
) -> Network:
    """Train on at most ``per_class`` labelled rows of each class (see ``labelled``); the network is made on the driver.

    Of a longer text, the driver gets ``per_text`` chunks spread evenly over all of it, so
    that what it holds is bounded in bytes.  The bounds are on what is learned from,
    not on what is scored.
    """
    small_batches(docs.sparkSession, 1000)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value in pdf["_text"]:
                raw = value.encode()
                places = np.unique(np.linspace(0, count(len(raw), shape) - 1, per_text).astype(np.int64)) * shape.step
                out.append(b"".join(next(cut(raw[p : p + shape.chunk], shape)).astype("<i2").tobytes() for p in places.tolist()))
            yield pd.DataFrame({"_id": pdf["_id"], "_label": pdf["_label"], "_chunks": out})

    rows = labelled(docs, labels, label, per_class, id, text).mapInPandas(chosen, "_id long, _label int, _chunks binary").orderBy("_id").collect()
    prior = labels.where(~held_out(id)).where(F.col(f"`{label}`").isin(0, 1)).agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
    samples = [np.frombuffer(r["_chunks"], "<i2").reshape(-1, shape.chunk) for r in rows]
    return train(samples, np.array([r["_label"] for r in rows], np.int64), prior, shape)


def quality(spark: SparkSession, network: Network) -> Callable[[Column], Column]:
    """The score as a function of a text column; a null text is an empty one."""
    small_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([(t or "").encode() for t in texts]))

    return score


def score_quality(docs: DataFrame, network: Network, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; every byte of every text is in a chunk, no shuffle.

    Null and empty texts get the score of a chunk of padding.  Repeated ids are scored
    row by row; a null id is not held out.  Other columns are not read.
    """
    score = quality(docs.sparkSession, network)
    out = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), held_out(id).alias("held_out"), score(text_or_empty(text)).alias("score"))
    return out.select(F.col("_id").alias(id), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
