"""Suffix-array dedup: remove every byte that lies in a repeated string of a given width.

A suffix array sorted only to ``width`` bytes has one group per repeated
window.  The sort is by most significant digit, in passes that drop a suffix
as soon as its group has no other member:

0. Each task settles what repeats among its own texts and sends one record of it.
1. *First digit, over the cluster.*  Of each window the smallest of its
   32-byte substrings (by hash) is its anchor, so equal windows have equal
   anchors at equal places.  Only one record per anchor (about 1.5 in 100
   bytes) is shuffled, by the anchor's hash.  Lone anchors leave.  Members whose
   whole span of windows agrees are settled at once.
2. *Second digit, within an anchor's group.*  One member of each different
   span sends its bytes; the windows are ordered by their first half, and
   lone ones leave.
3. *Last digit.*  What is left is ordered by the whole window.  Groups of two
   or more are the repeated windows.

A group with more than ``crowd`` different spans (a line that very many texts
share) is not gathered: its windows are dealt out one by one by their hash.
Every step is exact up to collisions of 64-bit hashes that agree in an anchor
and in a span at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import portions, small_batches, text_or_empty, written
from .texthash import Buffer, U, mix, sliding

_ANCHOR = 32
_SEGMENT = 1 << 20  # bytes of a text that are looked at together
_LONGEST = 1 << 19  # bytes of a settled run in one record
SPAN, REQUEST, SPREAD = 0, 1, 2


def _segments(texts: list[bytes], keys: np.ndarray, width: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in portions of about a segment; longer ones as segments that overlap by width - 1."""
    for a, b in portions(texts, _SEGMENT):
        if b - a > 1 or len(texts[a]) <= _SEGMENT:
            yield texts[a:b], keys[a:b], np.zeros(b - a, np.int64)
            continue
        for at in range(0, len(texts[a]) - width + 1, _SEGMENT - width + 1):
            yield [texts[a][at : at + _SEGMENT]], keys[a : a + 1], np.array([at], np.int64)


def anchors(texts: list[bytes], keys: np.ndarray, base: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The anchors of some texts: hash, hash of the span of its windows, where that is."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, reach = len(data), width - _ANCHOR
    if n < width:
        return {k: np.zeros(0, np.int64) for k in ("anchor", "span", "doc", "place")}
    buffer = Buffer(data)
    value = mix(buffer.all_of(_ANCHOR)) | U(1)
    least = sliding(value, reach + 1, np.minimum)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    least[text_of[: n - width + 1] != text_of[width - 1 :]] = 0  # a window that crosses a boundary
    pad = np.zeros(reach, U)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), reach + 1, np.maximum) == value)
    # Windows with the same least value are neighbours; find each anchor's run of them.
    run_start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    run_end = np.concatenate([run_start[1:], [len(least)]]) - 1
    run = np.searchsorted(run_end, at - reach)
    wrong = np.flatnonzero(least[run_start[run]] != value[at])
    while len(wrong):
        run[wrong] += 1
        wrong = wrong[least[run_start[run[wrong]]] != value[at[wrong]]]
    start = np.maximum(run_start[run], at - reach)
    end = np.minimum(run_end[run], at) + width
    where = at - start
    span = mix(buffer.at(start, end) + (end - start).astype(U) * U(0xA0761D6478BD642F) + where.astype(U) * U(0xE7037ED1A0B428DB))
    d = text_of[at]
    return {
        "anchor": value[at].view(np.int64), "span": span.view(np.int64), "doc": keys[d],
        "place": pack(start - first[d] + base[d], end - start),
    }


def pack(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Start and length (under 2**20) of a span in one integer."""
    return (start.astype(np.int64) << 20) | length.astype(np.int64)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 20, place & 0xFFFFF


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def combine(found: dict[str, np.ndarray], copies: np.ndarray) -> dict[str, np.ndarray]:
    """Settle what repeats among one task's own texts before anything is shuffled.

    ``copies`` says how many rows each record stands for.  Of a span that occurs
    twice here one record goes on, with weight 2; where it occurs is settled, and
    told in merged runs with weight 0 under a key of the text's own.  So a span
    or text that a third of all rows hold is one record per batch.
    """
    _, first, of = np.unique(mix(found["anchor"].view(U) * U(0x8EBC6AF09C88C6E3) + found["span"].view(U)), return_index=True, return_inverse=True)
    times = np.bincount(of, copies)
    many = times[of] > 1
    keep = ~many
    keep[first] = True
    out = {k: found[k][keep] for k in ("anchor", "span", "doc", "place")}
    out["weight"] = np.minimum(times[of[keep]], 2).astype(np.int64)
    if not many.any():
        return out
    doc, (start, length) = found["doc"][many], unpack(found["place"][many])
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    # The furthest end so far within a text; texts are kept apart by a large step.
    step = np.cumsum(_changes(doc)) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + step)
    new = np.concatenate([[True], (start + step)[1:] > reach[:-1]]) | _changes(doc)
    begins = np.flatnonzero(new)
    ends = (reach - step)[np.append(begins[1:], len(doc)) - 1]
    pieces = -(-(ends - start[begins]) // _LONGEST)
    at = np.repeat(start[begins], pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _LONGEST
    runs = {"doc": np.repeat(doc[begins], pieces), "place": pack(at, np.minimum(np.repeat(ends, pieces) - at, _LONGEST))}
    runs["anchor"] = mix(runs["doc"].view(U)).view(np.int64)
    runs["span"], runs["weight"] = runs["place"], np.zeros(len(at), np.int64)
    return {k: np.concatenate([out[k], runs[k]]) for k in out}


_ANCHORS = "anchor long, span long, doc long, place long, weight long"
_SETTLED = "anchor long, doc long, place long, kind int, known boolean"


def settle(crowd: int):
    """First pass: rows sorted by anchor, span, doc, place -> settled spans and requests for bytes.

    Memory is bounded by a batch and ``crowd`` rows, however large a group is:
    of a group that goes on in the next batch only one row per span is kept.
    """

    def rows(mask: np.ndarray, x: dict, kind: np.ndarray | int, known: np.ndarray | bool) -> pd.DataFrame:
        n = int(mask.sum())
        return pd.DataFrame({
            "anchor": x["anchor"][mask], "doc": x["doc"][mask], "place": x["place"][mask],
            "kind": np.broadcast_to(np.asarray(kind, np.int32), n), "known": np.broadcast_to(np.asarray(known, bool), n),
        })

    def step(x: dict, crowded: int | None, last: bool) -> tuple[list[pd.DataFrame], dict, int | None]:
        new_class = _changes(x["anchor"], x["span"])
        new_group = _changes(x["anchor"])
        row_class, class_at = np.cumsum(new_class) - 1, np.flatnonzero(new_class)
        times = np.add.reduceat(x["weight"], class_at)
        distinct = _changes(x["anchor"], x["span"], x["doc"], x["place"])
        out = [rows((times[row_class] > 1) & distinct & ~x["told"], x, SPAN, True)]
        group = (np.cumsum(new_group) - 1)[class_at]
        classes = np.bincount(group)
        spread = classes[group] > crowd
        if crowded is not None:
            spread |= x["anchor"][class_at] == crowded
        ask = (classes[group] > 1) | spread
        keep = np.zeros(len(class_at), bool)
        if not last:
            tail = group == group[-1]
            if spread[-1]:
                crowded = int(x["anchor"][-1])
                keep[-1] = True
                ask[-1] = False
            else:
                keep, ask = tail, ask & ~tail
        mask = np.zeros(len(row_class), bool)
        mask[class_at[ask]] = True
        out.append(rows(mask, x, np.where(spread[ask], SPREAD, REQUEST), times[ask] > 1))
        at = class_at[keep]
        carry = {k: v[at] for k, v in x.items()}
        carry["weight"] = np.minimum(times[keep], 2)
        carry["told"] = times[keep] > 1
        return [p for p in out if len(p)], carry, crowded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, crowded = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            weight = pdf["weight"].to_numpy()
            x = {k: pdf[k].to_numpy() for k in ("anchor", "span", "doc", "place")}
            if not weight.all():  # settled before the shuffle
                yield rows(weight == 0, x, SPAN, True)
                x, weight = {k: v[weight > 0] for k, v in x.items()}, weight[weight > 0]
                if not len(weight):
                    continue
            x["weight"], x["told"] = weight, np.zeros(len(weight), bool)
            if carry is not None:
                x = {k: np.concatenate([carry[k], x[k]]) for k in x}
            out, carry, crowded = step(x, crowded, False)
            yield from out
        if carry is not None and len(carry["anchor"]):
            yield from step(carry, crowded, True)[0]

    return run


def repeated_windows(
    spans: list[bytes], group: np.ndarray, doc: np.ndarray, start: np.ndarray, known: np.ndarray, width: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second and last digit: which windows of each span have an equal one in its group.

    A window that two spans of one text hold (their anchors tie) counts once.  Returns runs of such windows as (span, first window, last window), for the
    spans that are not known to be repeated as a whole.
    """
    lengths = np.fromiter(map(len, spans), np.int64, len(spans))
    first, n = np.cumsum(lengths) - lengths, lengths - width + 1
    # A large group has millions of windows: narrow numbers, and bytes are hashed a portion at a time.
    of = np.repeat(np.arange(len(spans), dtype=np.int32), n)
    at = np.ones(len(of), np.int32)
    at[np.cumsum(n)[:-1]] = 1 - n[:-1]
    at[:1] = 0
    np.cumsum(at, out=at)
    salt = group.astype(np.int64).view(U) * U(0x8EBC6AF09C88C6E3)

    def digits(reach: int) -> np.ndarray:
        out = np.empty(len(of), U)
        for a, b in portions(spans):
            lo, hi = np.searchsorted(of, [a, b])
            if lo < hi:
                buffer, mine = Buffer(np.frombuffer(b"".join(spans[a:b]), np.uint8)), of[lo:hi]
                place = (first - first[a])[mine] + at[lo:hi]
                out[lo:hi] = mix(buffer.at(place, place + reach) + salt[mine])
        return out

    owner = mix(salt + doc.astype(np.int64).view(U))
    _, inverse, times = np.unique(owner, return_inverse=True, return_counts=True)
    twice = np.flatnonzero((times[inverse] > 1)[of])
    if len(twice):
        place = mix(owner[of[twice]] + (start[of[twice]] + at[twice]).astype(U))
        once = np.ones(len(at), bool)
        once[twice] = False
        once[twice[np.unique(place, return_index=True)[1]]] = True
        of, at = of[once], at[once]
    for reach in (width // 2, width):
        digit = digits(reach)
        order = np.argsort(digit)
        digit = digit[order]
        same = digit[1:] == digit[:-1]
        del digit
        more = np.zeros(len(at), bool)
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
        del order, same
        of, at = of[more], at[more]
    mine = ~known[of]
    of, at = of[mine], at[mine]
    begins = np.flatnonzero(_changes(of, at - np.arange(len(at))))
    ends = np.append(begins[1:], len(at))[: len(begins)] - 1
    return of[begins], at[begins].astype(np.int64), at[ends].astype(np.int64)


def _compare(width: int):
    """Rows sorted by anchor -> spans of repeated windows; a group's rows stay together."""

    def work(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts).drop_duplicates(["anchor", "doc", "place"])
        doc, start = pdf["doc"].to_numpy(), unpack(pdf["place"].to_numpy())[0]
        of, a, b = repeated_windows(list(pdf["bytes"]), pdf["anchor"].to_numpy(), doc, start, pdf["known"].to_numpy(), width)
        return pd.DataFrame({"doc": doc[of], "place": pack(start[of] + a, b - a + width)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf["anchor"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield work([*held, pdf.iloc[:cut]])
                held = []
            elif held and held[-1]["anchor"].iloc[-1] != key[0]:
                yield work(held)
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield work(held)

    return run


def _cut(width: int, spread: bool):
    """Texts with their requests -> the bytes asked for, or each window of crowded groups by its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        previous = None
        for pdf in batches:
            out: dict[str, list] = {"anchor": [], "doc": [], "place": [], "known": [], "bytes": [], "span": []}
            for doc, text, asked, places, kinds, known in zip(
                pdf["_doc"], pdf["_text"], pdf["_anchors"], pdf["_places"], pdf["_kinds"], pdf["_known"],
            ):
                if doc == previous:  # a copy of the text before it
                    continue
                previous, raw = doc, text.encode()
                mine = np.flatnonzero((np.asarray(kinds) == SPREAD) == spread)
                starts, lengths = unpack(np.asarray(places)[mine])
                if not spread:
                    out["bytes"] += [raw[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
                    out["anchor"].append(np.asarray(asked)[mine])
                    out["known"].append(np.asarray(known)[mine])
                    out["place"].append(np.asarray(places)[mine])
                    out["doc"].append(np.full(len(mine), doc, np.int64))
                elif len(mine):
                    at = np.unique(np.concatenate([np.arange(s, s + n - width + 1) for s, n in zip(starts.tolist(), lengths.tolist())]))
                    low = int(at[0])
                    buffer = Buffer(np.frombuffer(raw[low : int(at[-1]) + width], np.uint8))
                    plain = buffer.at(at - low, at - low + width)
                    out["anchor"].append(mix(plain).view(np.int64))
                    out["span"].append(mix(mix(buffer.at(at - low, at - low + width // 2)) + plain).view(np.int64))
                    out["place"].append(pack(at, np.full(len(at), width)))
                    out["doc"].append(np.full(len(at), doc, np.int64))
            if out["doc"]:
                frame = pd.DataFrame({k: v if k == "bytes" else np.concatenate(v) for k, v in out.items() if v})
                yield frame.assign(weight=1) if spread else frame

    return run


def _removed(text: str, places, whole_characters: bool = False) -> tuple[int, int, int, bytes]:
    raw = text.encode()
    if places is None or not len(places):
        return len(raw), 0, 0, raw
    start, length = unpack(np.sort(np.asarray(places, np.int64)))
    end = np.maximum.accumulate(start + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    begins, ends = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    kept, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist()):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    if whole_characters:
        kept = [p.decode("utf-8", "ignore").encode() for p in kept]
    return len(raw), int((ends - begins).sum()), len(begins), b"".join(kept)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 200, crowd: int = 1 << 15, whole_characters: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts elsewhere.

    Returns the columns of ``docs`` (the text as it came) and n_bytes,
    n_removed, n_spans (maximal removed runs) and kept (the remaining bytes).
    Strings are judged on the input; all their copies go, within one text too.
    A null or empty text has no bytes; one shorter than ``width`` loses none.
    Rows with equal text, or with a null or repeated id, are separate texts, so
    a text of at least ``width`` bytes that occurs twice loses all of it.
    With ``whole_characters`` what is left of a character that was cut goes too
    (from kept, not from the counts), so that kept is a valid text.  Columns of
    the result that ``docs`` has already are replaced.
    """
    small_batches(docs.sparkSession)
    own = ("n_bytes", "n_removed", "n_spans", "kept")
    docs = docs.drop(*own)
    # Plain numbered names: columns of docs can't clash with the work columns.
    rest = [f"_{i}" for i in range(len(docs.columns))]
    # The texts are shuffled once: both joins below read the same exchange.
    keyed = docs.select(
        F.xxhash64(text_or_empty(text)).alias("_doc"), text_or_empty(text).alias("_text"),
        *(F.col(f"`{c}`").isNull().alias(n) if c == text else F.col(f"`{c}`").alias(n) for n, c in zip(rest, docs.columns)),
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, first, times = np.unique(pdf["_doc"].to_numpy(), return_index=True, return_counts=True)
            texts = [t.encode() for t in pdf["_text"].iloc[first]]
            parts = [anchors(some, own, base, width) for some, own, base in _segments(texts, keys, width)]
            found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {"doc": keys[:0]}
            if len(found["doc"]):
                yield pd.DataFrame(combine(found, times[np.searchsorted(keys, found["doc"])]))

    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("anchor").sortWithinPartitions("anchor", "span", "doc", "place")
        return rows.mapInPandas(settle(crowd), _SETTLED)

    first = written(settled(keyed.select("_doc", "_text").mapInPandas(find, _ANCHORS)), "repeats")
    asked = first.where(F.col("kind") != SPAN).groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_list("anchor").alias("_anchors"), F.collect_list("place").alias("_places"),
        F.collect_list("kind").alias("_kinds"), F.collect_list("known").alias("_known"),
    )
    joined = keyed.join(asked, "_doc")
    parts = joined.mapInPandas(_cut(width, False), "anchor long, doc long, place long, known boolean, bytes binary")
    second = parts.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compare(width), "doc long, place long")
    many = joined.where(F.array_contains("_kinds", SPREAD)).mapInPandas(_cut(width, True), _ANCHORS)
    third = settled(many).where(F.col("kind") == SPAN).select("doc", "place")
    spans = first.where(F.col("kind") == SPAN).select("doc", "place").unionByName(second).unionByName(third)
    spans = spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("place").alias("_places"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("_text").to_pylist(), batch.column("_places")
            result = [_removed(t, places[i].values if places[i].is_valid else None, whole_characters) for i, t in enumerate(texts)]
            new = [pa.array([r[i] for r in result], pa.int64() if i < 3 else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("_text", *rest)] + new, schema=out)

    schema = T.StructType([
        *(keyed.schema[n] for n in ("_text", *rest)), *(T.StructField(c, T.LongType()) for c in own[:3]), T.StructField("kept", T.BinaryType()),
    ])
    out = to_arrow_schema(schema)
    done = keyed.join(spans, "_doc", "left").mapInArrow(clean, schema)
    return done.select(*(
        F.when(~F.col(n), F.col("_text")).alias(c) if c == text else F.col(n).alias(c) for n, c in zip(rest, docs.columns)
    ), *own)
