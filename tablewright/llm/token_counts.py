"""Token counts by section: whole documents are encoded once, token spans are joined to section spans.

A token's place is known from the byte lengths of the tokens before it.  Tokens
that cross a boundary are allocated by an explicit rule:

* ``start``: the section its first byte lies in
* ``end``: the section its last byte lies in
* ``largest``: the section with most of its bytes, the earlier one of equals
* ``share``: every section, by its share of the token's bytes that lie in sections

Tokens (or shares) outside all sections count for none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import small_batches, text_or_empty

RULES = ("start", "end", "largest", "share")


def allocate(ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that end at ``ends`` (one after the other from 0), sections [begins, stops) in order.

    Returns for each section its tokens, and how many tokens lie partly in it
    and partly outside.
    """
    if not len(begins):
        return np.zeros(0), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    # The interval join: the sections first..last are the ones a token overlaps.
    first = np.searchsorted(stops, starts, "right")
    last = np.searchsorted(begins, ends, "left") - 1
    count = np.maximum(0, last - first + 1)
    token = np.repeat(np.arange(len(ends)), count)
    section = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    overlap = np.minimum(ends[token], stops[section]) - np.maximum(starts[token], begins[section])
    token, section, overlap = token[overlap > 0], section[overlap > 0], overlap[overlap > 0]
    crossing = np.bincount(section[overlap < (ends - starts)[token]], minlength=len(begins))
    if rule == "share":
        weight = overlap / np.bincount(token, overlap, len(ends))[token]
    elif rule == "largest":
        order = np.lexsort((section, -overlap, token))
        weight = np.zeros(len(token))
        weight[order[np.concatenate([[True], token[order][1:] != token[order][:-1]])[: len(order)]]] = 1
    else:
        at = starts[token] if rule == "start" else ends[token] - 1
        weight = ((begins[section] <= at) & (at < stops[section])).astype(float)
    return np.bincount(section, weight, len(begins)), crossing


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """Each line with its line break, as (number, first character, end)."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        if end > at:
            out.append((str(i), at, end))
        at = end
    return out


def _counted(rows: DataFrame, tokenizer: str, pattern: str, spans: Callable, rule: str, id: str) -> DataFrame:
    """rows: _id, _text, _lengths (of fields, or null) -> one row per section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(rows.sparkSession, 1000)
    columns = ["_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns).astype({"_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer, pattern)
        for pdf in batches:
            out: list[tuple] = []
            for name, value, lengths in zip(pdf["_id"].astype("Int64"), pdf["_text"], pdf["_lengths"]):
                found = spans(value, lengths)
                if not found:
                    continue
                ids = coder.encode(value)
                at = np.array([s[1:] for s in found], np.int64)
                if not value.isascii():
                    lead = (np.frombuffer(value.encode(), np.uint8) & 0xC0) != 0x80
                    at = np.append(np.flatnonzero(lead), len(lead))[at]
                tokens, crossing = allocate(np.cumsum(coder.lengths[ids]), at[:, 0], at[:, 1], rule)
                name = None if pd.isna(name) else name
                out += [(name, *s, t, c, len(ids)) for s, t, c in zip(found, tokens.tolist(), crossing.tolist())]
                if len(out) > 50_000:
                    yield frame(out)
                    out = []
            yield frame(out)

    made = rows.mapInPandas(run, "_id long, section string, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")
    return made.withColumnRenamed("_id", id)


def count_sections(
    docs: DataFrame, tokenizer: str, pattern: str, sections: Callable[[str], list[tuple[str, int, int]]] = line_sections,
    rule: str = "largest", id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document row and section: id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens.

    ``tokenizer`` is the path of a file of ranks and ``pattern`` its
    pre-tokenizer's; the file must be there on every executor.  ``sections``
    gives (name, first character, end) in order, without overlaps; gaps are
    allowed.  A text without sections (null, empty) has no rows.  Repeated and
    null ids are counted row by row.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), text_or_empty(text).alias("_text"), F.lit(None).cast("array<long>").alias("_lengths"))
    return _counted(rows, tokenizer, pattern, lambda value, _: sections(value), rule, id)


def count_fields(
    df: DataFrame, fields: list[str], tokenizer: str, pattern: str, rule: str = "largest", id: str = "doc_id", between: str = "\n",
) -> DataFrame:
    """Tokens of each field when a row is encoded as its fields joined by ``between``; rows as in ``count_sections``.

    A null field is empty; an empty field has no row.  What lies between fields counts for none.
    """
    values = [text_or_empty(f) for f in fields]
    rows = df.select(
        F.col(f"`{id}`").cast("long").alias("_id"), F.concat_ws(between, *values).alias("_text"), F.array(*(F.length(v).cast("long") for v in values)).alias("_lengths"),
    )

    def spans(_: str, lengths: np.ndarray) -> list[tuple[str, int, int]]:
        out, at = [], 0
        for name, n in zip(fields, map(int, lengths)):
            if n:
                out.append((name, at, at + n))
            at += n + len(between)
        return out

    return _counted(rows, tokenizer, pattern, spans, rule, id)
