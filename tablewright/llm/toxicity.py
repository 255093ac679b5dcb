"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, a text the mean of
its words and a few words without weight.  A run of over 64 letters, as in scripts
without blanks, counts as several words: pieces that overlap, so that no n-gram is lost.  An unseen misspelling shares most n-grams with the word it hides.
Once trained, each n-gram's vector times the softmax weights is one number, so a
text's score needs one look-up per word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .sampling import held_out, labelled

_WORD = re.compile(r"[^\W\d_]+")
_MOST_WORDS = 300_000  # words whose weight a worker keeps
_LONGEST = 64  # letters of a word or piece
_CUT = "\0"
_NEUTRAL = 8  # words without weight that every text's mean includes, so that three words can't decide alone


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of a word's character 3- to 5-grams and of the word itself; a piece of a run has no mark where it is cut."""
    whole = f"<{word}>".replace(f"<{_CUT}", "").replace(f"{_CUT}>", "")
    found = {whole} | {whole[i : i + n] for n in (3, 4, 5) for i in range(len(whole) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in sorted(found)]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; long ones in pieces, with ``_CUT`` at the ends that are none of the run's."""
    words = _WORD.findall(text.lower())
    if not words or len(max(words, key=len)) <= _LONGEST:
        return words
    out = []
    for w in words:
        step = _LONGEST - 4  # each 5-gram is in a piece
        for at in range(0, max(1, len(w) - 4), step) if len(w) > _LONGEST else (0,):
            out.append((_CUT if at else "") + w[at : at + _LONGEST] + (_CUT if at + _LONGEST < len(w) else ""))
    return out


@dataclass(frozen=True)
class Model:
    """Weight of each n-gram bucket, and the bias, of the score's log odds."""

    weight: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weight[grams(word, len(self.weight))].mean())

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            for w in {w for w in words if w not in known} if words else ():
                known[w] = self.word(w)
            out[i] = sum(map(known.__getitem__, words)) / (len(words) + _NEUTRAL)
            if len(known) > _MOST_WORDS:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def _bags(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as n-gram buckets with their share: (where texts begin, buckets, shares)."""
    known: dict[str, np.ndarray] = {}
    begins, ids, shares = [0], [], []
    for text in texts:
        words = words_of(text)
        for w in words:
            if w not in known:
                known[w] = np.array(grams(w, buckets), np.int32)
        if words:
            each = [known[w] for w in words]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            found, place = np.unique(np.concatenate(each), return_inverse=True)
            share = np.bincount(place, np.repeat(1.0 / (sizes * (len(each) + _NEUTRAL)), sizes))
        else:
            found, share = np.zeros(0, np.int32), np.zeros(0)
        ids.append(found)
        shares.append(share.astype(np.float32))
        begins.append(begins[-1] + len(found))
        if len(known) > _MOST_WORDS // 5:  # on the driver: arrays, not numbers
            known.clear()
    return np.array(begins), np.concatenate(ids), np.concatenate(shares)


def _telling(begins: np.ndarray, ids: np.ndarray, labels: np.ndarray, buckets: int, errors: float) -> np.ndarray:
    """Buckets that occur in three texts or more, and in one class more often by that many standard errors."""
    n, positive = len(labels), labels.sum()
    texts = np.bincount(ids, minlength=buckets)
    share = texts / n
    toxic = np.bincount(ids[np.repeat(labels > 0, np.diff(begins))], minlength=buckets)
    spread = np.sqrt(np.maximum(positive * share * (1 - share) * (n - positive) / n, 1e-9))
    return (np.abs(toxic - positive * share) >= errors * spread) & (texts >= 3)


def train(
    texts: list[str], labels: np.ndarray, prior: float | None = None, buckets: int = 1 << 18, dim: int = 16, epochs: int = 12,
    rate: float = 0.5, errors: float = 4.0, seed: int = 1,
) -> Model:
    """Embeddings and softmax weights by minibatch gradient steps with Adagrad.

    N-grams that don't tell the classes apart by ``errors`` standard errors keep
    a vector of zeros; thousands of them would otherwise drown the few that do
    in the mean of a long text.  ``prior`` is the share of label 1 among all
    labelled rows, where the sample has another.
    """
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(buckets, np.float32), 0.0 if not len(texts) else (8.0 if labels[0] else -8.0))
    begins, ids, shares = _bags(texts, buckets)
    keep = _telling(begins, ids, labels, buckets, errors)[ids]
    begins = np.concatenate([[0], np.cumsum(keep)])[begins]
    scale = 20.0  # the share of one n-gram in a text is small; this makes it of the order of 1
    ids, shares = ids[keep], shares[keep] * np.float32(scale)
    r = np.random.default_rng(seed)
    table = np.zeros((buckets, dim), np.float32)
    used_at_all = np.unique(ids)
    table[used_at_all] = r.normal(0, 0.01, (len(used_at_all), dim))
    out = (np.array([-1.0, 1.0]) * r.normal(1, 0.1, (dim, 2)) / np.sqrt(dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_table, seen_out, seen_bias = np.full(buckets, 1e-8, np.float32), np.full(out.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            sizes = begins[some + 1] - begins[some]
            places = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in some])
            row = np.repeat(np.arange(len(some)), sizes)
            used, share = ids[places], shares[places]
            mean = np.zeros((len(some), dim), np.float32)
            for k in range(dim):
                mean[:, k] = np.bincount(row, table[used, k] * share, len(some))
            logits = mean @ out + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            # A bucket's gradient is a multiple of the difference of the two classes' softmax weights.
            pull = np.bincount(used, error[row, 1] * share, buckets).astype(np.float32)
            touched = np.flatnonzero(pull)
            step = pull[touched, None] * (out[:, 1] - out[:, 0])
            seen_table[touched] += (step**2).mean(1)
            table[touched] -= rate * step / np.sqrt(seen_table[touched])[:, None]
            slope, push = mean.T @ error, error.sum(0)
            seen_out += slope**2
            out -= rate * 0.1 * slope / np.sqrt(seen_out)
            seen_bias += push**2
            bias -= rate * push / np.sqrt(seen_bias)
    shift = 0.0
    if prior is not None and 0 < prior < 1:
        shift = np.log(prior / (1 - prior)) - np.log(labels.mean() / (1 - labels.mean()))
    return Model((table @ (out[:, 1] - out[:, 0]) * scale).astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, id: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``per_class`` labelled rows of each class (see ``labelled``); the model is made on the driver.

    The bound is on rows, not on what is scored.  Without labelled rows every score is 0.5; with one class only, nearly 0 or 1.
    """
    rows = labelled(docs, labels, label, per_class, id, text).orderBy("_id").collect()
    prior = labels.where(~held_out(id)).where(F.col(f"`{label}`").isin(0, 1)).agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
    return train([r["_text"] for r in rows], np.array([r["_label"] for r in rows], np.int64), prior)


def toxicity(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The score as a function of a text column; a null or wordless text gets the score of the bias alone."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(shared.value.score([t or "" for t in texts], known))

    return score


def score_toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; whole texts, no shuffle.

    Repeated ids are scored row by row; a null id is not held out.  Other columns are not read.
    """
    score = toxicity(docs.sparkSession, model)
    out = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), held_out(id).alias("held_out"), score(text_or_empty(text)).alias("score"))
    return out.select(F.col("_id").alias(id), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
