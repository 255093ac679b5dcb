"""Benchmark decontamination: latent semantic retrieval of passages, then order and answer checks.

1. Texts are coded once as the benchmark's words (one number a word, 0 for any
   other word) and written.
2. Passages are blocks of words; document frequencies of the benchmark's words
   over all passages give TF-IDF weights.
3. A randomised SVD of the passage matrix: each task multiplies its passages by
   a random matrix and by their own transpose, the sums over all tasks span the
   leading singular directions.  The items' own vectors join that basis, so that
   projecting loses nothing of an item.
4. Passages near an item by cosine in that space are candidates.  So is, whatever
   its words weigh, every stretch of a text that holds enough of an item's rarest
   words: no text that keeps the least share of an item's words can hold fewer, and
   copies of an item in many texts can't hide each other.  The longest common
   subsequence of the item and the words around the candidate decides; a paraphrase
   that keeps half of the item counts if it also holds the item's answer (its last
   sentence) in full: in order, and word for word where only the rarest words led there,
   for among common words some half of an item and its answer meet by chance.  An
   answer of one or two words must stand word for word at the end of a stretch of the
   item's length and a block that holds, with the answer, half of the item in order.

Items are processed in blocks; what is broadcast is bounded by the benchmark's
vocabulary and one block of items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, small_batches, text_or_empty, written
from .texthash import word_hashes

_HALF = 12  # words in a block; a passage is two blocks next to each other
_SENTENCE = re.compile(r"[.!?\n]\s+|\n")


@dataclass(frozen=True)
class Benchmark:
    """Items as word numbers; ``vocabulary`` is sorted, a word's number is its place + 1."""

    ids: list[int]
    vocabulary: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]


def _raw(text: str) -> bytes:
    return text.lower().encode()


def read_benchmark(items: DataFrame, id: str = "item_id", text: str = "text") -> Benchmark:
    """Collect the query set; items without words or with a null id can't leak and are left out."""
    rows = items.select(F.col(f"`{id}`").cast("long"), text_or_empty(text)).where(F.col(f"`{id}`").isNotNull()).orderBy(id).collect()
    found = [(int(i), word_hashes([_raw(t)], True)[0], t) for i, t in rows]
    found = [x for x in found if len(x[1])]
    vocabulary = np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.uint64)
    number = lambda h: np.searchsorted(vocabulary, h).astype(np.int64) + 1
    answers = []
    for _, h, t in found:
        last = next(x for s in reversed(_SENTENCE.split(t.strip())) if len(x := word_hashes([_raw(s)], True)[0]))
        answers.append(number(last) if len(last) < len(h) else number(h))
    return Benchmark([i for i, _, _ in found], vocabulary, [number(h) for _, h, _ in found], answers)


def code_texts(docs: DataFrame, vocabulary: np.ndarray, keys: list[str], text: str) -> DataFrame:
    """Add _codes, each word's number as little-endian integers of 2 bytes (4 for a large vocabulary), and _n."""
    kind = _kind(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            raws, codes, n = [_raw(t) for t in pdf["_text"]], [], []
            for a, b in portions(raws):
                found, at = word_hashes(raws[a:b], True)
                place = np.searchsorted(known, found) if len(known) else np.zeros(len(found), np.int64)
                hit = known[np.minimum(place, len(known) - 1)] == found if len(known) else np.zeros(len(found), bool)
                number = np.where(hit, place + 1, 0).astype(kind)
                codes += [number[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
                n += np.diff(at).tolist()
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "_codes": codes, "_n": n})

    plain = docs.select(*keys, text_or_empty(text).alias("_text"))
    return plain.mapInPandas(run, ", ".join(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys) + ", _codes binary, _n long")


def _kind(vocabulary: np.ndarray) -> str:
    return "<u2" if len(vocabulary) < 65535 else "<u4"


def _blocks(codes: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of several texts, the block each word is in, and where each text's blocks begin."""
    parts = [np.frombuffer(c, kind) for c in codes]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    count = -(-sizes // _HALF)
    begins = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.repeat(begins[:-1], sizes) + inside // _HALF, begins


def document_frequencies(coded: DataFrame, size: int, kind: str) -> tuple[np.ndarray, int]:
    """Blocks that hold each word, and the number of blocks, over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, np.int64)
        for pdf in batches:
            for a, b in portions(list(pdf["_codes"])):
                words, block, begins = _blocks(list(pdf["_codes"][a:b]), kind)
                key = np.unique(block[words > 0] * (size + 1) + words[words > 0])
                total += np.bincount(key % (size + 1), minlength=size + 1)
                total[0] += begins[-1]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"word": some, "n": total[some]})

    rows = coded.select("_codes").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    blocks, out[0] = int(out[0]), 0
    return out, blocks


def leading_directions(coded: DataFrame, idf: np.ndarray, kind: str, rank: int, seed: int = 1) -> np.ndarray:
    """Random projections through the passage matrix and back, summed over all passages: (words, rank)."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), np.random.default_rng(seed).normal(size=(len(idf), rank)).astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, probe = shared.value
        total = np.zeros((len(weight), rank))
        for pdf in batches:
            for a, b in portions(list(pdf["_codes"])):
                words, block, _ = _blocks(list(pdf["_codes"][a:b]), kind)
                some = weight[words] > 0
                words, block = words[some], block[some]
                if not len(words):
                    continue
                w = weight[words]
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                row = np.cumsum(np.concatenate([[False], block[1:] != block[:-1]]))
                w = w / np.sqrt(np.add.reduceat(w * w, first))[row]
                hit = np.add.reduceat(probe[words] * w[:, None], first, axis=0)
                order = np.argsort(words, kind="stable")
                ordered = words[order]
                begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                total[ordered[begins]] += np.add.reduceat(hit[row[order]] * w[order, None], begins, axis=0)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        for at in range(0, len(some), 2000):
            part = some[at : at + 2000]
            yield pd.DataFrame({"word": part, **{f"y{k}": total[part, k] for k in range(rank)}})

    columns = [f"y{k}" for k in range(rank)]
    made = coded.select("_codes").mapInPandas(run, "word long, " + ", ".join(f"{c} double" for c in columns))
    out = np.zeros((len(idf), rank))
    for r in made.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        out[r["word"]] = r[1:]
    return out


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of one integer per word of the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        if m := places.get(w, 0):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


@dataclass(frozen=True)
class Holders:
    """Some items' rarest words: the items (``item``) of word w stand from ``at[w]`` to ``at[w + 1]``."""

    at: np.ndarray
    item: np.ndarray


def _rarest(words: np.ndarray, seen: np.ndarray, blocks: int, least: float) -> tuple[np.ndarray, int, float]:
    """Words of an item, how many of them every text that keeps the share ``least`` of it holds, and how often one is met.

    Of n words such a text keeps t, and so at least k of the n - t + k rarest; the
    k that costs least to look for is taken, by the words' frequencies.
    """
    n = len(words)
    t = min(n, max(1, math.ceil(least * n - 1e-9)))
    ordered = words[np.argsort(seen[words], kind="stable")]
    best = (np.inf, ordered, 1, 0.0)
    for k in range(1, t + 1):
        some = np.unique(ordered[: n - t + k])
        rate = float(seen[some].sum()) / max(1, blocks * _HALF)
        mean = rate * _span(n)
        chance = max(0.0, 1.0 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k - 1))) if mean else float(k == 1)
        # A candidate costs as much as some hundred words that are only met.
        best = min(best, (rate * (1 + 300 * chance), some, k, rate), key=lambda x: x[0])
    return best[1:]


def _span(n):
    """Words that an item of n words may be spread over: a passage and the item's length around it."""
    return 2 * _HALF + 2 * n


def rare_words(items: list[np.ndarray], seen: np.ndarray, blocks: int, least: float) -> tuple[list[Holders], np.ndarray]:
    """Holders of all items, in groups of which few words are met at a place of a text, and each item's least number."""
    found = [_rarest(words, seen, blocks, least) for words in items]
    groups, total = np.zeros(len(items), np.int64), 0.0
    for i, (_, _, rate) in enumerate(found):
        total += rate
        groups[i] = int(total // 4)
    out = []
    for g in np.unique(groups):
        mine = np.flatnonzero(groups == g)
        word = np.concatenate([found[i][0] for i in mine])
        item = np.repeat(mine, [len(found[i][0]) for i in mine]).astype(np.int32)
        out.append(Holders(np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(seen)))]), item[np.argsort(word, kind="stable")]))
    return out, np.array([k for _, k, _ in found], np.int64)


def _places(some: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where ``some`` stands word for word."""
    if not 0 < len(some) <= len(words):
        return np.zeros(0, np.int64)
    return np.flatnonzero((np.lib.stride_tricks.sliding_window_view(words, len(some)) == some).all(axis=1))


class Places:
    """Where each word stands in several texts put one after the other; text i begins at ``begins[i]``."""

    def __init__(self, words: np.ndarray, begins: np.ndarray) -> None:
        self.words, self.begins = words, begins
        self._span = len(words) + 1
        known = np.flatnonzero(words)
        self._key = np.sort(words[known] * self._span + known)

    def between(self, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How often each word stands in [first, last)."""
        return np.searchsorted(self._key, word * self._span + last) - np.searchsorted(self._key, word * self._span + first)


@dataclass(frozen=True)
class Index:
    """The latent space and one block of items in it; ``cosine`` and the overlaps are the thresholds.

    Item k has ``sizes[k]`` words; its different ones stand from ``starts[k]`` to ``starts[k + 1]`` in ``word``, each with its number in ``times``.
    """

    idf: np.ndarray
    basis: np.ndarray
    items: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    sizes: np.ndarray
    starts: np.ndarray
    word: np.ndarray
    times: np.ndarray
    holders: list[Holders]
    least: np.ndarray
    kind: str
    cosine: float
    overlap: float
    paraphrase: float

    def leaks(self, codes: list[bytes]) -> list[list[tuple[int, float]]]:
        """For each text the items it holds, each with the share of the item's words found in order."""
        words, block, begins = _blocks(codes, self.kind)
        done: dict[tuple[int, int], float] = {}
        counts = Places(words, np.concatenate([[0], np.cumsum([len(c) // np.dtype(self.kind).itemsize for c in codes])]).astype(np.int64))
        self._near(words, block, begins, counts, done)
        self._holding(words, counts, done)
        out: list[list[tuple[int, float]]] = [[] for _ in codes]
        for (text, k), share in sorted(done.items()):
            out[text].append((self.ids[k], share))
        return out

    def _near(self, words: np.ndarray, block: np.ndarray, begins: np.ndarray, counts: Places, done: dict[tuple[int, int], float]) -> None:
        """What stands around the passages near an item in the latent space."""
        some = self.idf[words] > 0
        if not some.any():
            return
        picked, at = words[some], block[some]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        full = at[first]  # blocks that hold a telling word
        latent = np.add.reduceat(self.basis[picked] * self.idf[picked, None], first, axis=0)
        # A passage is a block and the next one of the same text.
        follows = np.zeros(len(full), bool)
        text_of = np.searchsorted(begins, full, "right") - 1
        follows[:-1] = (full[1:] == full[:-1] + 1) & (text_of[1:] == text_of[:-1])
        passage = latent.copy()
        nxt = np.flatnonzero(follows)
        passage[nxt] += latent[nxt + 1]
        norm = np.sqrt((passage * passage).sum(axis=1))
        near = passage @ self.items.T >= self.cosine * norm[:, None]
        item, where = np.nonzero((near & (norm[:, None] > 0)).T)
        if not len(item):
            return
        # Candidates of one item that touch in one text are checked together.
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text_of[where[1:]] != text_of[where[:-1]]) | (full[where[1:]] > full[where[:-1]] + 2)
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(item)) - 1
        k, text, n = item[starts], text_of[where[starts]], self.sizes[item[starts]]
        first = (full[where[starts]] - begins[text]) * _HALF - n + counts.begins[text]
        last = (full[where[stops]] - begins[text] + 2) * _HALF + n + counts.begins[text]
        for k, text, around in self._possible(counts, k, text, first, last):
            share = self._share(k, around)
            if share:
                done[text, k] = max(share, done.get((text, k), 0.0))

    def _holding(self, words: np.ndarray, counts: Places, done: dict[tuple[int, int], float]) -> None:
        """What stands around the stretches that hold enough of an item's rarest words."""
        spans = _span(self.sizes)
        for held in self.holders:
            count = held.at[words + 1] - held.at[words]
            place = np.flatnonzero(count)
            count = count[place]
            if not len(place):
                continue
            first = np.cumsum(count) - count
            item = held.item[np.repeat(held.at[words[place]] - first, count) + np.arange(int(count.sum()))]
            order = np.argsort(item, kind="stable")
            item, place = item[order].astype(np.int64), np.repeat(place, count)[order]
            text = np.searchsorted(counts.begins, place, "right") - 1
            last = np.arange(len(item)) + self.least[item] - 1
            inside = last < len(item)
            first, last = np.flatnonzero(inside), last[inside]
            good = (item[first] == item[last]) & (text[first] == text[last]) & (place[last] - place[first] < spans[item[first]])
            first, last = first[good], last[good]
            if not len(first):
                continue
            # Stretches of one item that overlap are checked together; both ends rise.
            new = np.ones(len(first), bool)
            new[1:] = first[1:] > last[:-1]
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(first)) - 1
            first, last = first[starts], last[stops]
            k, t = item[first], text[first]
            n = self.sizes[k]
            for k, t, around in self._possible(counts, k, t, place[first] - n - _HALF, place[last] + n + _HALF):
                n = int(self.sizes[k])
                share = self._share(k, around, True)
                if share and len(around) > _span(n) + _HALF:
                    # A long stretch has more room than a leak may take: what decides is one place of it.
                    share = max(self._share(k, around[at : at + _span(n) + _HALF], True) for at in range(0, len(around) - _span(n), _HALF))
                if share:
                    done[t, k] = max(share, done.get((t, k), 0.0))

    def _possible(
        self, counts: Places, item: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray,
    ) -> Iterator[tuple[int, int, np.ndarray]]:
        """The stretches [first, last) that hold enough of the item's words in any order, cut to their texts: (item, text, words).

        No more of an item can be there in order than is there at all, a word counted as often as the item has it.
        """
        first, last = np.maximum(first, counts.begins[text]), np.minimum(last, counts.begins[text + 1])
        sizes = self.starts[item + 1] - self.starts[item]
        row = np.repeat(np.arange(len(item)), sizes)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[item], sizes)
        there = counts.between(self.word[entry], first[row], last[row])
        held = np.bincount(row, np.minimum(there, self.times[entry]), len(item))
        for i in np.flatnonzero(held >= min(self.overlap, self.paraphrase) * self.sizes[item]).tolist():
            yield int(item[i]), int(text[i]), counts.words[first[i] : last[i]]

    def _share(self, k: int, around: np.ndarray, literal: bool = False) -> float:
        """The share of an item's words that these words hold in order, 0 if that is no leak; ``literal``: a paraphrase's answer is word for word."""
        share = common_subsequence(self.words[k], around) / len(self.words[k])
        return share if share >= self.overlap or share >= self.paraphrase and self._answered(k, around, literal) else 0.0

    def _answered(self, k: int, around: np.ndarray, literal: bool) -> bool:
        """Whether an item's answer is there in full."""
        answer = self.answers[k]
        if len(answer) <= 2:
            # A word or two stand anywhere by chance: they must be next to the matched words.
            body = self.words[k][: len(self.words[k]) - len(answer)]
            wanted = self.paraphrase * len(self.words[k]) - len(answer)
            return any(common_subsequence(body, around[max(0, p - len(body) - _HALF) : p]) >= wanted for p in _places(answer, around).tolist())
        return bool(len(_places(answer, around))) if literal else common_subsequence(answer, around) == len(answer)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rank: int = 48, common: float = 0.002, cosine: float = 0.4, overlap: float = 0.7, paraphrase: float = 0.5, block: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, contaminated, item_ids, best_overlap.

    A text is contaminated by an item when ``overlap`` of the item's words stand
    in it in order within the item's length around a passage, or ``paraphrase``
    of them and the answer.  Words in more than ``common`` of all passages carry
    no weight in the latent space (they count in the order check); an item of such
    words only weighs them all alike.  What that space doesn't find for it, the
    search by rarest words does, which knows no limit on frequencies.  Words are
    runs of letters and digits in lower case.  A null or empty text is clean;
    items without words are left out; an empty benchmark contaminates nothing.
    Repeated and null ids are judged row by row; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    items = read_benchmark(benchmark, item_id, item_text)
    kind, size = _kind(items.vocabulary), len(items.vocabulary)
    plain = docs.select(F.col(f"`{id}`").cast("long").cast("string").alias("_id"), text_or_empty(text).alias("_text"))
    coded = written(code_texts(plain, items.vocabulary, ["_id"], "_text"), "coded")
    seen, blocks = document_frequencies(coded, size, kind)
    idf = np.log((blocks + 1) / (seen + 1.0)) * (seen <= max(1, common * blocks))
    idf[0] = 0.0
    for words in items.words:
        if not idf[words].any():
            idf[words] = np.maximum(idf[words], 1e-3 + np.log((blocks + 1) / (seen[words] + 1.0)).clip(0))
    spread = leading_directions(coded, idf, kind, rank) if size else np.zeros((1, rank))
    found = coded.withColumns({"item_ids": F.array().cast("array<long>"), "best_overlap": F.lit(0.0)})
    for at in range(0, len(items.ids), block):
        some = items.words[at : at + block]
        vectors = np.zeros((len(some), size + 1))
        for i, words in enumerate(some):
            np.add.at(vectors[i], words, idf[words])
        # Singular directions of the corpus and the items' own, as one orthonormal basis.
        left, values, _ = np.linalg.svd(np.concatenate([vectors.T, spread / max(1e-12, np.abs(spread).max())], axis=1), full_matrices=False)
        basis = left[:, values > 1e-9 * max(values[0], 1e-300)]
        latent = vectors @ basis
        latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1, keepdims=True)), 1e-12)
        different = [np.unique(w, return_counts=True) for w in some]
        holders, least = rare_words(some, seen, blocks, min(overlap, paraphrase))
        index = Index(
            idf.astype(np.float32), basis.astype(np.float32), latent.astype(np.float32), items.ids[at : at + block], some,
            items.answers[at : at + block], np.array([len(w) for w in some]), np.concatenate([[0], np.cumsum([len(w) for w, _ in different])]),
            np.concatenate([w for w, _ in different]), np.concatenate([n for _, n in different]), holders, least, kind, cosine, overlap, paraphrase,
        )
        found = _search(found, index)
    return found.select(
        F.col("_id").cast("long").alias(id), F.col("_n").alias("n_words"), (F.size("item_ids") > 0).alias("contaminated"), F.array_sort("item_ids").alias("item_ids"), "best_overlap"
    )


def _search(coded: DataFrame, index: Index) -> DataFrame:
    """Add one block's items to what each row has found already."""
    shared = coded.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaks = []
            for a, b in portions(list(pdf["_codes"]), 1 << 18):
                leaks += shared.value.leaks(list(pdf["_codes"][a:b]))
            yield pdf.assign(
                item_ids=[[*have, *(i for i, _ in x)] for have, x in zip(pdf["item_ids"], leaks)],
                best_overlap=[max([have, *(s for _, s in x)]) for have, x in zip(pdf["best_overlap"], leaks)],
            )

    return coded.mapInPandas(run, coded.schema)
