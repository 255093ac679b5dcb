"""Ranked lexical search with per-term geometric blocking.

1. Each text is hashed once into words; what it holds of the items' vocabulary
   is written as (term, occurrences), with its length.  Counts over all texts give
   document frequencies, the number of texts and of words, and so each posting's
   impact: its exact integer share of a score.
2. Every task takes its texts in segments and builds, in a segment, each term's
   posting list.  A list is cut into blocks of similar documents: some of the list's
   documents are centres, every document goes to the centre nearest to it by the
   cosine of a random projection of their impacts.
3. A block stores a summary: the highest impact among its documents, coordinate by
   coordinate.  The sum of an item's coordinates bounds the score of every document
   in the block.  A document counts as found in the list of the rarest term it shares
   with an item, so a list's summary needs that term and more frequent ones only, and
   of those only the ones that some item holds together with it.
4. Blocks are visited from the highest bound down.  A block is skipped only if
   its bound is below the score of the item's last place so far; equal bounds are
   visited, as the smaller id wins.  The result is exact.
5. A task keeps the best documents of each item over all its segments; these, a few
   rows per item and task, are ranked in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, small_batches, text_or_empty, written
from .texthash import word_hashes

_CELLS = 8_000_000  # documents times terms of a segment
_DOCUMENTS = 4096  # of a segment, at most
_BLOCK = 24  # documents for which a list gets a centre
_LARGEST = 64  # documents of a block, at most
_DIRECTIONS = 32  # of the random projection
_NO_ID = np.iinfo(np.int64).max  # stands for a null id, which is ranked last among equals


@dataclass(frozen=True)
class Items:
    """The query set: vocabulary as sorted word hashes, and each item's different terms as places in it."""

    ids: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and where each text's begin; only A-Z are lower-cased."""
    return word_hashes([t.lower() for t in texts], True)


def read_items(items: DataFrame, id: str, text: str) -> Items:
    """Collect the query set; an item without terms finds nothing."""
    rows = items.select(F.col(f"`{id}`").cast("long"), text_or_empty(text)).collect()
    hashes = [np.unique(_words([t.encode()])[0]) for _, t in rows]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return Items([r[0] for r in rows], vocabulary, [np.searchsorted(vocabulary, h) for h in hashes])


def code_texts(docs: DataFrame, vocabulary: np.ndarray, id: str, text: str) -> DataFrame:
    """(_id, _n, _terms, _tf): a text's number of words, and the vocabulary's terms in it with their occurrences."""
    plain = docs.select(F.col(f"`{id}`").cast("long").cast("string").alias("_id"), text_or_empty(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            raws, out = [t.encode() for t in pdf["_text"]], []
            for a, b in portions(raws):
                found, at = _words(raws[a:b])
                place = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                hit = known[place] == found if len(known) else np.zeros(len(found), bool)
                text_of = np.repeat(np.arange(b - a), np.diff(at))[hit]
                key, times = np.unique(text_of * max(1, len(known)) + place[hit], return_counts=True)
                ends = np.searchsorted(key // max(1, len(known)), np.arange(b - a + 1))
                term = (key % max(1, len(known))).astype("<i4")
                out += [(n, term[x:y].tobytes(), times[x:y].astype("<i4").tobytes()) for n, x, y in zip(np.diff(at).tolist(), ends[:-1], ends[1:])]
            yield pd.DataFrame({"_id": pdf["_id"], "_n": [o[0] for o in out], "_terms": [o[1] for o in out], "_tf": [o[2] for o in out]})

    return plain.mapInPandas(run, "_id string, _n long, _terms binary, _tf binary")


@dataclass(frozen=True)
class Statistics:
    """``frequency`` is the number of texts with each term of the vocabulary."""

    texts: int
    words: int
    frequency: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.texts + 2) / (2 * self.frequency + 1))).astype(np.int64)

    def impacts(self, terms: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The share of a score of each posting; ``n`` is the number of words of its text."""
        m = 100 - 90 + (90 * n * self.texts) // max(1, self.words)
        return self.weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def statistics(coded: DataFrame, size: int) -> Statistics:
    """Counts over all texts; each task adds up its own, the driver gets one row per term."""
    total = coded.agg(F.count(F.when(F.col("_n") > 0, 1)), F.sum("_n")).first()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(size, np.int64)
        for pdf in batches:
            found += np.bincount(np.frombuffer(b"".join(pdf["_terms"]), "<i4"), minlength=size)
        some = np.flatnonzero(found)
        yield pd.DataFrame({"term": some, "n": found[some]})

    frequency = np.zeros(size, np.int64)
    for r in coded.select("_terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r["term"]] = r["n"]
    return Statistics(total[0], total[1] or 0, frequency)


@dataclass(frozen=True)
class Plan:
    """Some items' terms in the order of lists: the rarest term is 0.

    ``used`` are their places in the vocabulary of all items.  The list of
    term t has summaries over ``coordinates[t]``; ``asks[t]`` are the items that
    hold t, ``picks[t]`` says which coordinates each of them adds up.
    """

    numbers: np.ndarray
    used: np.ndarray
    terms: list[np.ndarray]
    coordinates: list[np.ndarray]
    asks: list[np.ndarray]
    picks: list[np.ndarray]


def _columns(used: np.ndarray, size: int) -> np.ndarray:
    """The number of the list of each term of the vocabulary, or -1."""
    column = np.full(size, -1, np.int64)
    column[used] = np.arange(len(used))
    return column


def plan(items: Items, counts: Statistics, numbers: np.ndarray) -> Plan:
    used = np.unique(np.concatenate([items.terms[k] for k in numbers] or [np.zeros(0, np.int64)]).astype(np.int64))
    used = used[(counts.frequency[used] > 0) & (counts.weight[used] > 0)]
    used = used[np.argsort(counts.frequency[used], kind="stable")]
    column = _columns(used, len(items.vocabulary))
    terms = [np.sort(c[c >= 0]) for k in numbers for c in [column[items.terms[k]]]]
    of_term: list[list[int]] = [[] for _ in used]
    for k, own in enumerate(terms):
        for t in own.tolist():
            of_term[t].append(k)
    coordinates, picks = [], []
    for t, asking in enumerate(of_term):
        later = np.unique(np.concatenate([terms[k][terms[k] >= t] for k in asking]))
        pick = np.zeros((len(later), len(asking)))
        for x, k in enumerate(asking):
            pick[np.isin(later, terms[k]), x] = 1
        coordinates.append(later)
        picks.append(pick)
    return Plan(numbers, used, terms, coordinates, [np.array(a, np.int64) for a in of_term], picks)


class Segment:
    """Posting lists of some texts in blocks with summaries.  Impacts and their sums are whole numbers below 2**53."""

    def __init__(self, ids: np.ndarray, texts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, how: Plan) -> None:
        """``ids`` of the texts; postings as (number of text, term by ``Plan``, impact above 0), in order of texts."""
        self.ids, self.how = ids, how
        self.matrix = np.zeros((len(ids), max(1, len(how.coordinates))))
        self.matrix[texts, terms] = impacts
        order = np.argsort(terms, kind="stable")
        lists = np.searchsorted(terms[order], np.arange(len(how.coordinates) + 1))
        self.block_at, self.lists, self.bounds = [], [], []
        near = self._places()
        for t in np.flatnonzero(np.diff(lists)).tolist():
            members, begins = self._blocks(texts[order[lists[t] : lists[t + 1]]], near)
            summary = np.maximum.reduceat(self.matrix[members[:, None], how.coordinates[t]], begins, axis=0)
            bound = summary @ how.picks[t]
            first = len(self.block_at)
            ends = np.append(begins[1:], len(members))
            self.block_at += [members[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            self.lists.append(t)
            block, asking = np.indices(bound.shape)
            self.bounds.append((how.asks[t][asking.ravel()], first + block.ravel(), bound.ravel()))

    def _places(self) -> np.ndarray:
        """Texts as directions in a space of few dimensions, in which near ones are alike."""
        size = self.matrix.shape[1]
        if size > _DIRECTIONS:
            seen = self.matrix @ np.random.default_rng(1).normal(size=(size, _DIRECTIONS))
        else:
            seen = self.matrix
        return (seen / np.maximum(np.sqrt((seen * seen).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)

    @staticmethod
    def _blocks(list_: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A list's texts ordered by block, and where each block begins."""
        count = len(list_) // _BLOCK
        if count < 2:
            return list_, np.arange(0, len(list_), _LARGEST)
        centres = list_[np.linspace(0, len(list_) - 1, count).astype(np.int64)]
        nearest = (near[list_] @ near[centres].T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        ordered = nearest[order]
        inside = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        return list_[order], np.flatnonzero(inside % _LARGEST == 0)

    def search(self, best: Best) -> tuple[int, int]:
        """Improve every item's best documents; returns how many (item, block) pairs there were and how many were visited."""
        if not self.bounds:
            return 0, 0
        item, block, bound = (np.concatenate([b[x] for b in self.bounds]) for x in range(3))
        order = np.lexsort((-bound, item))
        item, block, bound = item[order], block[order], bound[order]
        begins = np.searchsorted(item, np.arange(len(self.how.terms) + 1))
        visited = 0
        for k in np.flatnonzero(np.diff(begins)).tolist():
            at, end, step = int(begins[k]), int(begins[k + 1]), 2
            done = np.zeros(len(self.ids), bool)
            while at < end and bound[at] > 0 and bound[at] >= best.floor(k):
                # Of the next blocks, those that the floor lets through; a few first, then more.
                to = min(end, at + step)
                to = at + int(np.searchsorted(-bound[at:to], -max(1.0, best.floor(k)), "right"))
                texts = np.unique(np.concatenate([self.block_at[x] for x in block[at:to].tolist()]))
                texts = texts[~done[texts]]
                done[texts] = True
                best.add(k, self.ids[texts], self.matrix[texts[:, None], self.how.terms[k]].sum(axis=1))
                visited += to - at
                at, step = to, step * 4
        return len(item), visited


class Best:
    """The highest-scoring documents of each item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.ids = [np.zeros(0, np.int64)] * items
        self.scores = [np.zeros(0)] * items

    def floor(self, k: int) -> float:
        """The score of the last place, 0 while places are free."""
        return float(self.scores[k][-1]) if len(self.scores[k]) == self.top else 0.0

    def add(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.floor(k))
        ids, scores = np.concatenate([self.ids[k], ids[good]]), np.concatenate([self.scores[k], scores[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.ids[k], self.scores[k] = ids[order], scores[order]


def segments(batches: Iterator[pd.DataFrame], counts: Statistics, how: Plan) -> Iterator[Segment]:
    """Coded texts as segments, as large as ``_CELLS`` allows."""
    columns = _columns(how.used, len(counts.frequency))
    most = max(1, min(_DOCUMENTS, _CELLS // max(1, len(how.coordinates))))
    for pdf in batches:
        for at in range(0, len(pdf), most):
            some = pdf.iloc[at : at + most]
            ids = some["_id"].fillna(str(_NO_ID)).astype("int64").to_numpy()
            terms, times = (np.frombuffer(b"".join(some[c]), "<i4").astype(np.int64) for c in ("_terms", "_tf"))
            text = np.repeat(np.arange(len(some)), (some["_terms"].map(len) // 4).to_numpy(np.int64))
            impacts = counts.impacts(terms, times, some["_n"].to_numpy(np.int64)[text])
            column = columns[terms] if len(terms) else terms
            good = (column >= 0) & (impacts > 0)
            yield Segment(ids, text[good], column[good], impacts[good], how)


def rank(
    docs: DataFrame, items: DataFrame, top: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = 256,
) -> DataFrame:
    """The ``top`` highest-scoring rows of ``docs`` for each row of ``items``: item_id, rank, doc_id, score; score above 0, equal scores by id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with
    A-Z lower-cased, told by 64-bit hashes.  Null and empty texts have no terms; an
    item without terms, or whose terms all documents hold, has no rows.  Repeated
    rows of ``docs`` are ranked one by one; of ``items``, each row is an item.  A null
    id of a document is ranked after the others of its score and stays null.  Other
    columns are not read.  The items are the query set and are collected; documents
    are coded and counted while the frame is built.  Items are searched ``block`` at a time.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    asked = read_items(items, item_id, item_text)
    coded = written(code_texts(docs, asked.vocabulary, id, text), "lexical")
    counts = statistics(coded, len(asked.vocabulary))
    plans = [plan(asked, counts, np.arange(at, min(at + block, len(asked.ids)))) for at in range(0, len(asked.ids), block)]
    shared = spark.sparkContext.broadcast((asked.ids, counts, plans))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, numbers, hows = shared.value
        best = [Best(len(how.terms), top) for how in hows]
        for pdf in batches:
            for how, found in zip(hows, best):
                for segment in segments(iter([pdf]), numbers, how):
                    segment.search(found)
        task = TaskContext.get().partitionId()
        for how, found in zip(hows, best):
            n = [len(x) for x in found.ids]
            if sum(n):
                item = np.repeat(how.numbers, n)
                yield pd.DataFrame({
                    "_item": item, "_name": pd.array([names[k] for k in item.tolist()], "Int64"), "_id": np.concatenate(found.ids),
                    "score": np.concatenate(found.scores).astype(np.int64), "_part": task % 64,
                })

    found = coded.mapInPandas(run, "_item long, _name long, _id long, score long, _part int")
    order = [F.col("score").desc(), F.col("_id")]
    some = found.withColumn("_place", F.row_number().over(Window.partitionBy("_item", "_part").orderBy(*order))).where(F.col("_place") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= top)
    return last.select(F.col("_name").alias(item_id), "rank", F.when(F.col("_id") != _NO_ID, F.col("_id")).alias(id), "score")
