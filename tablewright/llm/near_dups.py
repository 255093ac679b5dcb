"""MinHash near-dedup: one-permutation hashing, optimal densification, star-shaped candidates.

A text's set of word shingles is hashed once; the hash range is cut into
``bands * rows`` bins and the least hash of each bin is the signature.  An empty
bin borrows from a non-empty one that a fixed random sequence of its own finds,
the same for all texts (optimal densification).  Texts that agree in all rows of
a band share a bucket.

Buckets never emit all pairs.  One hub is compared with the others, on full
sets, and what links becomes one component.  Where the other members of a bucket
still belong to different components, an exact way handles the rest: of each
such member only its rarest shingles, as many as a similar text must share one
of, are joined.  The place of a shingle tells how long a partner can be at most,
and the join key holds the partner's length, so texts that share a template but
too little else don't meet at all.  A pair of one component needs no comparison,
so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import portions, small_batches, text_or_empty, written
from .components import components
from .texthash import U, mix, word_hashes

_FINE = 64  # classes of length an e-fold: texts of one class differ by at most 1.6 % in length
_BLOCK = 4096  # postings of one key that a block holds, on either side, about

_ODD = np.random.default_rng(5).integers(1, 2**62, 64, dtype=U) * U(2) + U(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text; ASCII letters in lower case."""
    raws = [t.encode().lower() for t in texts]  # bytes.lower changes A-Z only
    out = []
    for a, b in portions(raws):
        found, at = word_hashes(raws[a:b])
        n = max(0, len(found) - words + 1)
        run = np.zeros(n, U)
        for k in range(words):
            run += found[k : k + n] * _ODD[k]
        run = mix(run)
        for i in range(b - a):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= words:
                out.append(np.unique(run[lo : hi - words + 1]))
            elif hi > lo:
                out.append(mix((found[lo:hi] * _ODD[words : words + hi - lo]).sum(keepdims=True) + U(hi - lo)))
            else:
                out.append(found[:0])
    return out


def _layout(bins: int, tries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Where each bin of the hash range begins, and the bins it borrows from in turn when it is empty."""
    begins = np.arange(bins, dtype=U) * U((1 << 64) // bins + 1)
    return begins, np.random.default_rng(11).integers(0, bins, (tries, bins))


def signature(shingles: np.ndarray, begins: np.ndarray, detours: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification; ``shingles`` is sorted and not empty."""
    bins = len(begins)
    at = np.searchsorted(shingles, begins)
    end = np.append(at[1:], len(shingles))
    full = end > at
    out = np.zeros(bins, U)
    out[full] = shingles[at[full]]
    empty = np.flatnonzero(~full)
    for turn in detours:
        if not len(empty):
            return out
        source = turn[empty]
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    if len(empty):  # very few shingles: the next full bin
        have = np.flatnonzero(full)
        out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
    return out


def _signatures(words: int, bands: int, rows: int):
    bins = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins, detours = _layout(bins)
        salt = _ODD[np.arange(rows) % 64] + np.arange(bands, dtype=U)[:, None] * U(0x9E3779B97F4A7C16)
        for pdf in batches:
            sets = shingle_sets(list(pdf["_text"]), words)
            keys = [
                mix((signature(s, begins, detours).reshape(bands, rows) * (salt | U(1))).sum(axis=1) + np.arange(bands, dtype=U)).view(np.int64)
                if len(s) else None for s in sets
            ]
            out = pd.DataFrame({
                "_id": pdf["_id"].astype("Int64"), "n": [len(s) for s in sets], "whole": [xxh3_128_digest(s.tobytes()) for s in sets], "keys": keys,
            })
            # Copies inside a batch are linked here, so that a set that many documents have is no hot key later.
            out["near"] = out.groupby("whole")["_id"].transform("min").astype("Int64")
            yield out

    return run


def _similar(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pd.unique(pd.concat([pdf["text_a"], pdf["text_b"]]))
            sets = dict(zip(texts, shingle_sets(list(texts), words)))
            linked = []
            for a, b in zip(pdf["text_a"], pdf["text_b"]):
                x, y = sets[a], sets[b]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    linked.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[np.array(linked, bool), ["a", "b"]]

    return run


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Two texts are linked when the shared shingles are at least ``percent`` of
    the shingles of both.  A text of fewer than ``words`` words has its whole
    sequence as one shingle; an empty or null text has none and links with
    nothing.  component_id is the smallest id reached over links; kept says that
    it is the row's own.  Rows that repeat an id stand for one document, whose
    links are those of any of its texts.  A row with a null id keeps a null
    component, links with nothing and is kept.  Other columns are not read.

    At the similarity asked for, a pair misses all 40 bands of 5 rows with a
    probability of 1e-7 at 0.8 and 7e-11 at 0.85.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    sigs = written(
        plain.mapInPandas(_signatures(words, bands, rows), "_id long, n long, whole binary, keys array<long>, near long"), "signatures",
    )
    # Texts with the same set are one node: only the smallest id of each set goes on.
    named = sigs.where("n > 0 and _id is not null")
    # Of a batch only the smallest does: a set meets at most once a batch, however many rows have it.
    close = named.where("_id != near").select(F.col("near").alias("a"), F.col("_id").alias("b"))
    first = named.where("_id = near").select("_id", "whole", "keys")
    same = first.join(first.groupBy("whole").agg(F.min("_id").alias("rep")), "whole")
    copies = close.unionByName(same.where("_id != rep").select(F.col("rep").alias("a"), F.col("_id").alias("b"))).distinct()
    entries = same.where("_id = rep").select(F.col("rep").alias("doc"), F.explode("keys").alias("key")).distinct()
    hubs = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("doc").alias("hub")).where("members > 1")
    buckets = written(entries.join(hubs, "key").select("key", "doc", "hub"), "buckets")
    asked = buckets.select(F.col("doc").alias("_id")).distinct()
    texts = written(plain.join(asked, "_id", "left_semi").dropDuplicates(["_id", "_text"]), "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda s: texts.select(F.col("_id").alias(s), F.col("_text").alias(f"text_{s}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(_similar(words, percent), "a long, b long").distinct()

    pairs = written(buckets.where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    groups = written(components(copies.unionByName(confirmed(pairs))), "groups")
    label = F.coalesce("component", "doc")
    rest = buckets.where("doc != hub").join(groups.withColumnRenamed("id", "doc"), "doc", "left").select("key", "doc", label.alias("label"))
    mixed = rest.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("key")
    open_ = written(rest.join(mixed, "key", "left_semi").select("doc", "label").distinct(), "open")
    more = written(_rare_shingle_pairs(texts, open_, words, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = written(confirmed(more), "found")
    if not found.isEmpty():
        groups = written(components(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(found)), "groups")
    rows_ = sigs.select("_id", "n").join(groups.withColumnRenamed("id", "_id"), "_id", "left")
    component = F.coalesce("component", "_id")
    return rows_.select(
        F.col("_id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def _rare_shingle_pairs(texts: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a < b) of members with different labels that can be similar: a superset of all that are.

    A member's shingles are put in order of how many members have them.  Two
    sets with ``percent`` in common share one of the first n - percent * n / 100
    + 1 of each, and from their first common shingle on both have at least as
    many left as they must share.
    """
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = shingle_sets(list(pdf["_text"]), words)
            yield pd.DataFrame({
                "doc": pdf["doc"], "label": pdf["label"], "n": [len(x) for x in found],
                "whole": [xxh3_128_digest(x.tobytes()) for x in found], "all": [x.view(np.int64) for x in found],
            })

    rows = texts.withColumnRenamed("_id", "doc").join(members, "doc").select("doc", "label", "_text")
    rows = rows.mapInPandas(sets, "doc long, label long, n long, whole binary, all array<long>")
    rows = written(rows.select("doc", "label", "n", "whole", F.explode("all").alias("shingle")), "shingles")
    # A shingle that one component alone has links nothing new.
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), (F.min("label") != F.max("label")).alias("meets"))
    order = Window.partitionBy("doc", "whole").orderBy("often", "shingle")
    rows = rows.join(often, "shingle").withColumn("place", F.row_number().over(order))
    need = F.floor((F.col("n") * percent + 99) / 100)
    first = rows.where((F.col("place") <= F.col("n") - need + 1) & F.col("meets"))
    x, y = _meetings(written(first.select("shingle", "doc", "label", "n", (F.col("n") - F.col("place") + 1).alias("left")), "first"), percent)
    fits = (
        (F.col("x.label") != F.col("y.label")) & (F.col("x.n") >= F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
        & ((100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n")))
    )
    same_key = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in _KEY]
    return x.join(y, [*same_key, fits]).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


_KEY = ("shingle", "class", "row", "column")


def _meetings(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The postings (shingle, doc, label, n, left) as x, the longer text of a pair, and y, the shorter one, with the key they meet by.

    ``left`` is how many shingles a text has from this one on.  Similar texts
    whose first common shingle this is have (100 + percent) * left >= percent *
    (sum of both lengths) on either side.  So x asks for the lengths from
    percent * n / 100 to its own or what ``left`` allows, in classes of length;
    y answers only if ``left`` is enough for a partner of its own length.  A key
    of many postings is dealt out: x to rows and y to columns of a grid, whose
    every cell is a key of its own.
    """
    n, left = F.col("n"), F.col("left")
    size_class = lambda length: F.floor(F.log(length.cast("double")) * _FINE)
    least = F.floor((n * percent + 99) / 100)
    most = F.least(n, F.floor(left * (100 + percent) / percent) - n)
    asks = postings.where(least <= most).withColumn("class", F.explode(F.sequence(size_class(least), size_class(most))))
    answers = postings.where((100 + percent) * left >= 2 * percent * n).withColumn("class", size_class(n))
    both = asks.select("shingle", "class", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        answers.select("shingle", "class", F.lit(0).alias("x"), F.lit(1).alias("y")))
    blocks = lambda side: F.ceil(F.sum(side) / _BLOCK)
    grids = both.groupBy("shingle", "class").agg(blocks("x").alias("rows"), blocks("y").alias("columns"))
    grids = grids.where("rows > 0 and columns > 0")
    one = lambda of: F.pmod(F.xxhash64("doc"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    x = asks.join(grids, ["shingle", "class"]).withColumn("row", one("rows")).withColumn("column", every("columns"))
    y = answers.join(grids, ["shingle", "class"]).withColumn("column", one("columns")).withColumn("row", every("rows"))
    return x.alias("x"), y.alias("y")
