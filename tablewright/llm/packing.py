"""Packing documents into fixed windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, small_batches, text_or_empty
from .wordbpe import WordEncoder, encoder

BLOCK = 1 << 22  # ids that one task packs together, at most: 16 MB
PORTION = 3 << 19  # bytes of text that are encoded together: what that takes beside them is some thirty times as much


class OpenWindows:
    """A segment tree over remaining capacities 0..size: which have an open window, and the tightest that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._count(capacity, 1)

    def _count(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += change
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity >= need, as (capacity, window)."""
        node = self.leaves + need
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1  # climb until a right sibling has an open window
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each piece (none longer than ``size``), and how full each window is."""
    tree, window, offset, filled = OpenWindows(size), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = tree.tightest(need)
        if got is None:
            got = size, len(filled)
            filled.append(0)
        capacity, w = got
        window[i], offset[i] = w, filled[w]
        filled[w] += need
        if capacity > need:
            tree.add(capacity - need, w)
    return window, offset, np.array(filled, np.int64)


def layout(totals: np.ndarray, size: int, slack: int = 16) -> dict[str, np.ndarray]:
    """Pieces of documents of those lengths, each with its window and offset.

    Full windows are cut off overlong documents, the rest is packed by
    best-fit decreasing.  A window that would stay empty by more than one part
    in ``slack`` is cut into windows of powers of two, which need no padding.
    """
    whole = totals // size
    doc = np.repeat(np.arange(len(totals)), whole)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * size
    n = len(doc)
    rest = np.flatnonzero(totals % size)
    window, offset, filled = best_fit_decreasing((totals % size)[rest], size)
    doc, start = np.concatenate([doc, rest]), np.concatenate([start, whole[rest] * size])
    length = np.concatenate([np.full(n, size, np.int64), (totals % size)[rest]])
    window, offset = np.concatenate([np.arange(n), window + n]), np.concatenate([np.zeros(n, np.int64), offset])
    sparse = np.flatnonzero(size - filled > size // slack) + n
    if not len(sparse):
        return {"doc": doc, "start": start, "length": length, "window": window, "offset": offset}
    loose = np.isin(window, sparse)
    pieces = [list(x) for x in (doc[~loose], start[~loose], length[~loose], window[~loose], offset[~loose])]
    next_window = n + len(filled)
    for w in sparse.tolist():
        mine = np.flatnonzero(window == w)
        mine = mine[np.argsort(offset[mine])]
        left, room, at = int(filled[w - n]), 0, 0
        for i in mine.tolist():
            d, s, todo = int(doc[i]), int(start[i]), int(length[i])
            while todo:
                if not room:
                    room, at = 1 << (left.bit_length() - 1), 0
                    left -= room
                    next_window += 1
                part = min(todo, room)
                for column, value in zip(pieces, (d, s, part, next_window - 1, at)):
                    column.append(value)
                s, todo, room, at = s + part, todo - part, room - part, at + part
    return dict(zip(("doc", "start", "length", "window", "offset"), (np.array(x, np.int64) for x in pieces)))


def documents_ids(coder: WordEncoder, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text with ``end_id`` after them; only a portion's are held at a time."""
    for a, b in portions(texts, PORTION):
        codes, at = coder.encode(texts[a:b])
        codes = codes.astype("<u4")
        for k in range(b - a):
            yield np.append(codes[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``size`` ids; one row per piece.

    ``tokenizer`` is the path of a tokenizers file whose pre-tokenizer drops
    white space; it must be there on every executor.  ``end_id`` ends each
    document, so a null or empty text is one piece of one id.  Each task packs
    its own rows in blocks of up to 4 million ids, without a shuffle: at most
    the last window of a block is not full.  Sequence ids are unique, not
    gapless.  Rows with a null or repeated id are packed like any others.  With ``ids``, the ids of a piece
    come as an array in column ids.  Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def put(rows: list[tuple], found: list[np.ndarray], task: int, made: int) -> tuple[pd.DataFrame, int]:
        totals = np.fromiter(map(len, found), np.int64, len(found))
        x = layout(totals, size)
        parts = [found[d][s : s + n] for d, s, n in zip(x["doc"].tolist(), x["start"].tolist(), x["length"].tolist())]
        names = pd.array([rows[d] for d in x["doc"].tolist()], "Int64")
        out = pd.DataFrame({
            "id": names, "start": x["start"], "length": x["length"], "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
            "doc_tokens": totals[x["doc"]], "sequence_id": (task << 36) + made + x["window"], "offset": x["offset"],
        })
        if ids:
            out["ids"] = [p.astype(np.int64) for p in parts]
        return out, made + int(x["window"].max()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        rows: list = []
        found: list[np.ndarray] = []
        held = made = 0
        for pdf in batches:
            texts, names = list(pdf["_text"]), [None if pd.isna(i) else int(i) for i in pdf["_id"]]
            for name, one in zip(names, documents_ids(coder, texts, end_id)):
                if held and held + len(one) > BLOCK:
                    out, made = put(rows, found, task, made)
                    yield out
                    rows, found, held = [], [], 0
                rows.append(name)
                found.append(one)
                held += len(one)
        if found:
            yield put(rows, found, task, made)[0]

    plain = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    out = plain.mapInPandas(run, PIECES + (", ids array<long>" if ids else ""))
    return out.withColumnRenamed("id", id)
