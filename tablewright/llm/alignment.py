"""Cross-tokenizer alignment by merge-path partitioning.

The tokens of two tokenizers A and B that spell the same bytes are told by their
ends.  The ends of many texts, one text after the other, are merged: diagonals
at equal distances are cut by binary searches (``merge_path``), so that each
piece takes the same number of ends and none needs another piece.  A piece emits
its overlaps: between two ends that follow each other lies one pair of tokens,
each overlapping pair once (``piece``).  An end that both tokenizers have closes
a group; where such a pair of equal ends was cut apart, and where a group goes
on in the next piece, the pieces are stitched (``stitched``).

1. Texts are encoded by both tokenizers and written as ids.
2. Each task counts the pairs of ids that its overlaps link; the counts are summed
   over the corpus in a written table, with the highest count of each B id.
3. Each text's links are made again and look up their pair's count.  A table
   of at most ``most_pairs`` rows (counted, not guessed) is broadcast; a larger
   one is joined with the different pairs of each group of some million tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import small_batches, text_or_empty
from .tokenizer_pair import ByteLevel, Pieces, loaded, number_kind

_PIECE = 1 << 16  # ends that a piece takes
_PORTION = 1 << 19  # tokens that are aligned at a time
_GROUP = 2_000_000  # tokens of a group, about
_HELD = 4_000_000  # links or different pairs that a task holds before it adds them up


def merge_path(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before each diagonal 0, size, 2 size, ..., len(a) + len(b); of equal ends a's comes first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (wide := np.flatnonzero(low < high)).size:
        middle = (low[wide] + high[wide]) // 2
        more = a[middle] <= b[diagonal[wide] - middle - 1]
        low[wide] = np.where(more, middle + 1, low[wide])
        high[wide] = np.where(more, high[wide], middle)
    return low, diagonal - low


def piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The overlaps that end at a's ends i[0]..i[1] and b's ends j[0]..j[1]: (A token, B token, whether both end there, carry).

    ``carry``: the first end here is the last one of the pieces before, whose last overlap therefore closes a group.
    """
    before = max(a[i[0] - 1] if i[0] else 0, b[j[0] - 1] if j[0] else 0)
    both = np.concatenate([2 * a[i[0] : i[1]], 2 * b[j[0] : j[1]] + 1])
    both.sort(kind="stable")
    end, from_b = both >> 1, both & 1
    new = np.ones(len(both), bool)
    new[1:] = end[1:] != end[:-1]
    new[0] = end[0] > before
    taken_b = np.cumsum(from_b) - from_b
    at = np.flatnonzero(new)
    closes = np.zeros(len(both), bool)
    closes[:-1] = ~new[1:]
    return i[0] + at - taken_b[at], j[0] + taken_b[at], closes[at], not new[0]


def stitched(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' overlaps one after the other: (A token, B token, whether it is its group's last)."""
    closes = [p[2] for p in pieces]
    last = None
    for k, p in enumerate(pieces):
        if p[3] and last is not None:
            closes[last][-1] = True
        last = k if len(p[2]) else last
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), np.concatenate(closes)


def overlaps(a: np.ndarray, b: np.ndarray, size: int = _PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two tokenizations with the same last end."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i, j = merge_path(a, b, size)
    return stitched([piece(a, b, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(i) - 1)])


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level file (A) and a piece model (B); the files must be there on every executor."""

    a: str
    b: str

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + text by A and of the text by B; none where their bytes aren't those of " " + text."""
        first, second = loaded(ByteLevel, self.a), loaded(Pieces, self.b)
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        x, y, raw = first.encode(" " + text), second.encode(text), (" " + text).encode()
        if b"".join(map(first.tokens.__getitem__, x.tolist())) != raw or b"".join(map(second.tokens.__getitem__, y.tolist())) != raw:
            return none, none
        return x, y

    @property
    def kinds(self) -> tuple[str, str]:
        return number_kind(loaded(ByteLevel, self.a).size), number_kind(loaded(Pieces, self.b).size)


class Aligned:
    """The overlaps of several texts, given as the ids of their tokens."""

    def __init__(self, names: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        first, second = loaded(ByteLevel, names.a), loaded(Pieces, names.b)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.a, self.b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        self.i, self.j, self.closes = overlaps(np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b]))
        self.pair = self.a[self.i] << 32 | self.b[self.j]
        text = np.repeat(np.arange(len(a)), self.n_a)
        of_link = text[self.i]
        self.n_links = np.bincount(of_link, minlength=len(a))
        self.n_groups = np.bincount(of_link[self.closes], minlength=len(a))

    def by_text(self, value: np.ndarray) -> np.ndarray:
        """Sum of a number of each link, by text."""
        total = np.concatenate([[0], np.cumsum(value)])
        ends = np.cumsum(self.n_links)
        return total[ends] - total[ends - self.n_links]

    def groups(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(self.i):
            return [b""] * len(self.n_a)
        group = np.cumsum(self.closes) - self.closes
        # The group of a token is that of its first link.
        first = lambda token: np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        of_a, of_b = group[first(self.i)], group[first(self.j)]
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        at_a = np.arange(len(of_a)) + (np.cumsum(in_b) - in_b)[of_a]
        at_b = np.arange(len(of_b)) + np.cumsum(in_a)[of_b]
        ids = np.empty(len(at_a) + len(at_b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[at_a[np.cumsum(in_a) - 1]] = ord("|")
        mark[at_b[np.cumsum(in_b) - 1]] = ord(";")
        digits, used = _decimals(int(ids.max()) + 1)
        shown = np.concatenate([digits[ids], mark[:, None]], axis=1)
        there = np.concatenate([used[ids], np.ones((len(ids), 1), bool)], axis=1)
        size = there.sum(axis=1)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(self.n_a + self.n_b)]
        data = shown[there].tobytes()
        # Without the mark after a text's last group.
        return [data[b : e - 1] if n else b"" for b, e, n in zip([0, *ends[:-1].tolist()], ends.tolist(), self.n_a.tolist())]


_numbers: list[tuple[np.ndarray, np.ndarray]] = []


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0..n-1 in columns, and which of them are used."""
    if not _numbers or len(_numbers[0][0]) < n:
        size = max(n, 1 << 16)
        width = len(str(size - 1))
        value = np.arange(size)[:, None] // 10 ** np.arange(width - 1, -1, -1)[None, :]
        used = value > 0
        used[:, -1] = True
        _numbers[:] = [((value % 10 + ord("0")).astype(np.uint8), used)]
    return _numbers[0]


def _portions(frame: pd.DataFrame, kinds: tuple[str, str]) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """Rows of about ``_PORTION`` tokens together, a long text alone, with their ids."""
    size = (frame["_a"].map(len) // np.dtype(kinds[0]).itemsize).tolist()
    at = 0
    while at < len(size):
        to, total = at + 1, size[at]
        while to < len(size) and total + size[to] <= _PORTION:
            total += size[to]
            to += 1
        yield at, to, [np.frombuffer(x, kinds[0]) for x in frame["_a"][at:to]], [np.frombuffer(x, kinds[1]) for x in frame["_b"][at:to]]
        at = to


def encode(docs: DataFrame, names: Tokenizers, id: str, text: str) -> DataFrame:
    """(_group, _id, _a, _b): both tokenizers' ids as little-endian integers; a group is some million tokens of one task."""
    plain = docs.select(F.col(f"`{id}`").cast("long").cast("string").alias("_id"), text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind_a, kind_b = names.kinds
        group, size = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            out = []
            for name, value in zip(pdf["_id"], pdf["_text"]):
                x, y = names.encode(value)
                out.append((group, name, x.astype(kind_a).tobytes(), y.astype(kind_b).tobytes()))
                size += len(x)
                if size >= _GROUP:
                    group, size = group + 1, 0
            yield pd.DataFrame(out, columns=["_group", "_id", "_a", "_b"])

    return plain.mapInPandas(run, "_group long, _id string, _a binary, _b binary")


def count_pairs(coded: DataFrame, names: Tokenizers) -> DataFrame:
    """(_pair, n): how many links of the corpus hold a pair of ids linked.

    Each task adds up its own links before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in held]))
            return key, total

        def given(key: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
            for at in range(0, len(key), 100_000):
                yield pd.DataFrame({"_pair": key[at : at + 100_000], "n": n[at : at + 100_000]})

        for pdf in batches:
            for _, _, a, b in _portions(pdf, names.kinds):
                held.append(np.unique(Aligned(names, a, b).pair, return_counts=True))
                size += len(held[-1][0])
                if size >= _HELD:
                    held[:] = [added()]
                    size = len(held[0][0])
                    if size >= _HELD // 2:
                        yield from given(*held.pop())
                        size = 0
        if held:
            yield from given(*added())

    pairs = coded.select("_a", "_b").mapInPandas(run, "_pair long, n long").groupBy("_pair").agg(F.sum("n").alias("n"))
    return _kept(pairs, "pairs")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Write under the shared checkpoint folder and read back, packed tightly."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_best(pairs: DataFrame) -> DataFrame:
    b = F.col("_pair").bitwiseAND((1 << 32) - 1)
    most = pairs.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    # One row per id of B's vocabulary, whatever the corpus.
    return pairs.withColumn("_b", b).join(F.broadcast(most), "_b").select("_pair", "n", (F.col("n") == F.col("_most")).alias("best"))


_RESULT = "_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _results(frame: pd.DataFrame, names: Tokenizers, key: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of the result for coded texts, all of whose pairs are among the sorted ``key``."""
    for at, to, a, b in _portions(frame, names.kinds):
        x = Aligned(names, a, b)
        pair, place = np.unique(x.pair, return_inverse=True)
        found = np.searchsorted(key, pair)
        shown = x.groups()
        yield pd.DataFrame({
            "_id": frame["_id"].iloc[at:to].to_numpy(), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links,
            "n_best": x.by_text(best[found][place].astype(np.int64)), "count_sum": x.by_text(n[found][place]),
            "groups_sha256": [hashlib.sha256(s).hexdigest() if s else "" for s in shown],
        })


def _by_broadcast(spark: SparkSession, coded: DataFrame, pairs: DataFrame, names: Tokenizers) -> DataFrame:
    got = pairs.toArrow()
    key = got.column("_pair").to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], got.column("n").to_numpy()[order], got.column("best").to_numpy(zero_copy_only=False)[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _results(pdf, names, *shared.value)

    return coded.select("_id", "_a", "_b").mapInPandas(run, _RESULT)


def _by_join(coded: DataFrame, pairs: DataFrame, names: Tokenizers) -> DataFrame:
    """A pair is asked for once in a group, so that a frequent one is no hot key."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, np.zeros(0, np.int64)
        for pdf in batches:
            for group, some in pdf.groupby("_group", sort=False):
                if group != now:
                    yield pd.DataFrame({"_group": np.full(len(known), now or 0, np.int64), "_pair": known})
                    now, known = group, np.zeros(0, np.int64)
                for _, _, a, b in _portions(some, names.kinds):
                    known = np.union1d(known, Aligned(names, a, b).pair)
        yield pd.DataFrame({"_group": np.full(len(known), now or 0, np.int64), "_pair": known})

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        key, first = np.unique(known["_pair"].to_numpy(np.int64), return_index=True)
        n, best = known["n"].to_numpy(np.int64)[first], known["best"].to_numpy(bool)[first]
        return pd.concat(list(_results(texts, names, key, n, best)), ignore_index=True)

    found = coded.select("_group", "_a", "_b").mapInPandas(asked, "_group long, _pair long").join(pairs.hint("merge"), "_pair")
    return coded.groupBy("_group").cogroup(found.select("_group", "_pair", "n", "best").groupBy("_group")).applyInPandas(run, _RESULT)


def align(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id: str = "doc_id", text: str = "text", most_pairs: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A group is what lies between two byte offsets where tokens of both end;
    a link is a pair of an A token and a B token whose bytes overlap.  A pair of ids
    counts how many links of the corpus hold it linked; ``n_best`` are the links
    whose count is the highest of their B id, ties included.  Null and empty texts,
    and texts that either tokenizer doesn't give back byte by byte, have no tokens:
    zeros and an empty string.  Repeated rows count as often as they occur; null
    ids stay null; other columns are not read.  Encoding and counting run while the
    frame is built; ``most_pairs`` bounds what is broadcast, 17 bytes a pair.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    names = Tokenizers(tokenizer_a, tokenizer_b)
    coded = _kept(encode(docs, names, id, text), "token_ids")
    pairs = count_pairs(coded, names)
    few = pairs.count() <= most_pairs
    out = _by_broadcast(spark, coded, _with_best(pairs), names) if few else _by_join(coded, _with_best(pairs), names)
    return out.select(F.col("_id").cast("long").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align_texts(texts: list[str], tokenizer_a: str, tokenizer_b: str) -> list[list[tuple[list[int], list[int]]]]:
    """The groups themselves, as (A ids, B ids), of a few texts."""
    names = Tokenizers(tokenizer_a, tokenizer_b)
    coded = [names.encode(t) for t in texts]
    shown = Aligned(names, [a for a, _ in coded], [b for _, b in coded]).groups()
    return [[tuple([int(x) for x in side.split(b",")] for side in g.split(b"|")) for g in s.split(b";")] if s else [] for s in shown]
