"""LM scoring: cross-entropy difference of matched target and background n-gram models.

Both models are bigram models over the same vocabulary, a public byte-level
tokenizer's, with the same smoothing; the background's counts are scaled to the
target's size, so that smoothing weighs the same in both.  The target is every
text labelled 1, the background every text of the corpus.  Bigrams are counted
exactly, in a table that grows with the corpus; to score, texts are taken in
groups, and each different bigram of a group is joined to that table once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import small_batches, text_or_empty, written

_GROUP = 1 << 21  # tokens whose bigrams a task holds at once


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Bigrams as numbers."""
    return before.astype(np.int64) << 32 | token.astype(np.int64)


def _chained(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of several texts and what stands before each of them, ``start`` before a text's first."""
    ids = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    before = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return before, ids


@dataclass(frozen=True)
class Models:
    """Counts of both models: [target, background] by token, and the table of bigrams (_pair, target, background).

    ``scale`` is what the background's counts are multiplied by; it is in ``tokens`` already.
    Where ``same``, both models are the background.
    """

    tokens: np.ndarray
    pairs: DataFrame
    scale: float
    same: bool
    weight: float

    def losses(self, ids: np.ndarray, start: int) -> tuple[float, float]:
        """Mean loss per token, in nats, of the target and the background model; looks the bigrams of one text up."""
        known = np.unique(pairs(*_chained([ids], start)))
        got = self.pairs.where(F.col("_pair").isin(known.tolist())).orderBy("_pair").toPandas()
        counts = got[["target", "background"]].to_numpy(np.float64)
        out = Scale(self.tokens, self.scale, self.same, self.weight).losses([ids], start, got["_pair"].to_numpy(np.int64), counts)
        return float(out[0].mean()), float(out[1].mean())


@dataclass(frozen=True)
class Scale:
    """What of the models doesn't grow with the corpus."""

    tokens: np.ndarray
    scale: float
    same: bool
    weight: float

    def losses(self, texts: list[np.ndarray], start: int, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Loss of each token of several texts, one after the other; ``known`` are sorted bigrams, ``counts`` theirs."""
        before, ids = _chained(texts, start)
        pair = pairs(before, ids)
        place = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        hit = known[place] == pair if len(known) else np.zeros(len(pair), bool)
        out = np.empty((2, len(ids)))
        for k, factor in ((0, 1.0), (1, self.scale)):
            total = self.tokens[k].sum() + self.tokens.shape[1]
            seen = np.where(hit, counts[place, 1 if self.same else k], 0.0) * factor if len(known) else np.zeros(len(ids))
            unigram = (self.tokens[k, ids] + 1.0) / total
            out[k] = -np.log((seen + self.weight * unigram) / (self.tokens[k, before] + self.weight))
        return out


def count(docs: DataFrame, labels: DataFrame, label: str, tokenizer: str, pattern: str, id: str, text: str) -> DataFrame:
    """(_pair, target, background): exact counts of bigrams; (start, start) has the number of texts.

    Every text counts for the background, every text with the label 1 for the
    target as well.  Each task adds up its own rows, some million tokens at a
    time, before they are shuffled.
    """
    one = labels.select(F.col(f"`{id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
    good = one.where("_id is not null").groupBy("_id").agg(F.min("_label").alias("_label")).where("_label = 1")
    plain = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    # Labels grow with the corpus: a shuffled join at any size.
    rows = plain.join(good.hint("merge"), "_id", "left").select("_text", F.col("_label").isNotNull().alias("_target"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer, pattern)

        def added(held: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
            # A text is counted once here, as target or not; the background is their sum.
            found = []
            for texts in held:
                key, n = np.unique(pairs(*_chained(texts, coder.size)), return_counts=True)
                found.append((np.append(key, pairs(np.array([coder.size]), np.array([coder.size]))), np.append(n, len(texts))))
            key, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = [np.bincount(p, m, len(key)).astype(np.int64) for p, m in zip(np.split(place, [len(found[0][0])]), (m for _, m in found))]
            for at in range(0, len(key), 100_000):
                to = at + 100_000
                yield pd.DataFrame({"_pair": key[at:to], "target": n[1][at:to], "background": (n[0] + n[1])[at:to]})

        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for pdf in batches:
            for value, target in zip(pdf["_text"], pdf["_target"]):
                ids = coder.encode(value).astype(np.int32)
                held[int(target)].append(ids)
                size += len(ids) + 1
                if size >= _GROUP:
                    yield from added(held)
                    held, size = [[], []], 0
        if size:
            yield from added(held)

    counted = rows.mapInPandas(run, "_pair long, target long, background long")
    return counted.groupBy("_pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def fit(
    docs: DataFrame, labels: DataFrame, tokenizer: str, pattern: str, label: str = "quality", weight: float = 200.0, id: str = "doc_id", text: str = "text",
) -> Models:
    """Count both models over the whole corpus; the driver gets one row per token, the bigrams are written.

    Without target rows both models are the background.
    """
    small_batches(docs.sparkSession, 1000)
    size = encoder(tokenizer, pattern).size + 1
    table = written(count(docs, labels, label, tokenizer, pattern, id, text), "bigrams")
    token = F.col("_pair").bitwiseAND((1 << 32) - 1).alias("token")
    got = table.groupBy(token).agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
    found, place = np.zeros((2, size)), got.column("token").to_numpy()
    found[0, place], found[1, place] = got.column("target").to_numpy(), got.column("background").to_numpy()
    same = not found[0].any()
    if same:
        found[0] = found[1]
    scale = float(found[0].sum() / max(1.0, found[1].sum()))
    found[1] *= scale
    return Models(found, table.where(F.col("_pair") != ((size - 1) << 32 | (size - 1))), scale, same, weight)


def _coded(docs: DataFrame, tokenizer: str, pattern: str, id: str, text: str) -> DataFrame:
    """(_group, _id, _ids): a text's tokens as little-endian integers of 2 bytes (4 for a large vocabulary); a group is some million tokens of one task."""
    plain = docs.select(F.col(f"`{id}`").cast("long").cast("string").alias("_id"), text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer, pattern)
        kind = "<u2" if coder.size < 65536 else "<u4"
        group, size = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            groups, ids = [], []
            for value in pdf["_text"]:
                ids.append(coder.encode(value).astype(kind))
                groups.append(group)
                size += len(ids[-1])
                if size >= _GROUP:
                    group, size = group + 1, 0
            yield pd.DataFrame({"_group": groups, "_id": pdf["_id"], "_ids": [x.tobytes() for x in ids]})

    return plain.mapInPandas(run, "_group long, _id string, _ids binary")


def _asked(coded: DataFrame, start: int) -> DataFrame:
    """(_group, _pair): the different bigrams of each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = "<u2" if start < 65536 else "<u4"
        now, known = None, np.zeros(0, np.int64)

        def asked() -> Iterator[pd.DataFrame]:
            for at in range(0, len(known), 100_000):
                yield pd.DataFrame({"_group": np.int64(now), "_pair": known[at : at + 100_000]})

        for pdf in batches:
            for group, some in pdf.groupby("_group", sort=False)["_ids"]:
                if group != now:
                    yield from asked()
                    now, known = group, np.zeros(0, np.int64)
                known = np.union1d(known, pairs(*_chained([np.frombuffer(x, kind) for x in some], start)))
        yield from asked()

    # A file may be read in pieces, and a group with it; a bigram may then be asked for in each.
    return coded.select("_group", "_ids").mapInPandas(run, "_group long, _pair long")


def score(docs: DataFrame, models: Models, tokenizer: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, target_loss, background_loss, difference, selected.

    ``difference`` is target minus background loss per token: the lower, the
    more a text is like the target.  ``selected`` says that it is below 0.  A null
    or empty text has no tokens, null losses, and is not selected.  Repeated and
    null ids are scored row by row; other columns are not read.  Texts are written
    as tokens first; a bigram is in a group once, so that a frequent one is no hot key.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    start = encoder(tokenizer, pattern).size
    shared = spark.sparkContext.broadcast(Scale(models.tokens, models.scale, models.same, models.weight))
    coded = written(_coded(docs, tokenizer, pattern, id, text), "tokens")
    found = _asked(coded, start).join(models.pairs, "_pair").select("_group", "_pair", "target", "background")

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        kind = "<u2" if start < 65536 else "<u4"
        key, first = np.unique(known["_pair"].to_numpy(np.int64), return_index=True)
        counts = known[["target", "background"]].to_numpy(np.float64)[first]
        ids = [np.frombuffer(x, kind) for x in texts["_ids"]]
        n, t, b = [len(x) for x in ids], [], []
        at = 0
        while at < len(ids):  # some hundred thousand tokens at a time
            to, size = at, 0
            while to < len(ids) and (to == at or size + n[to] <= 1 << 18):
                size += n[to]
                to += 1
            ends = np.cumsum(n[at:to])
            losses = shared.value.losses(ids[at:to], start, key, counts)
            for e, m in zip(ends.tolist(), n[at:to]):
                t.append(float(losses[0, e - m : e].mean()) if m else None)
                b.append(float(losses[1, e - m : e].mean()) if m else None)
            at = to
        return pd.DataFrame({"_id": texts["_id"], "n_tokens": n, "target_loss": pd.array(t, "Float64"), "background_loss": pd.array(b, "Float64")})

    out = coded.groupBy("_group").cogroup(found.groupBy("_group")).applyInPandas(run, "_id string, n_tokens long, target_loss double, background_loss double")
    gap = F.col("target_loss") - F.col("background_loss")
    return out.select(
        F.col("_id").cast("long").alias(id), "n_tokens", "target_loss", "background_loss", gap.alias("difference"), F.coalesce(gap < 0, F.lit(False)).alias("selected")
    )
