"""Vectorised hashes of byte strings, all from one prefix sum per buffer.

A byte string t[a:b] hashes to sum(value[t[i]] * BASE**-(i-a)) modulo 2**64, so
any substring costs two look-ups in the prefix sums.  Strings that are equal
have equal hashes wherever they stand; the last mixing step spreads the bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.empty(n, U), 1
    out[0] = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = _powers(base, max(n, 1 << 16) * 5 // 4)
    return _tables[name]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Buffer:
    """Prefix sums over one byte buffer."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.up = _table("up", _BASE, n + 1)
        down = _table("down", pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_VALUE[data] * down[:n], out=self.sums[1:])

    def all_of(self, width: int) -> np.ndarray:
        """Unmixed hash of every substring of that width."""
        n = len(self.sums) - 1
        return (self.sums[width:] - self.sums[: n + 1 - width]) * self.up[: n + 1 - width]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hash of data[start:end] for arrays of positions."""
        return (self.sums[end] - self.sums[start]) * self.up[start]


def sliding(x: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """choose.reduce over every window of that width, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = choose(x[:-have], x[have:]), have * 2
    rest = width - have
    return choose(x[:-rest], x[rest:]) if rest else x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bounds(data: np.ndarray, ends: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a buffer of texts that end at ``ends``.

    Words are runs of bytes other than ASCII white space, or with ``letters``
    runs of ASCII letters, digits and bytes beyond ASCII.  No word crosses the
    end of a text.
    """
    inside = _LETTER[data] if letters else ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops


def word_hashes(texts: list[bytes], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit hash of every word of the texts, and where each text's words begin.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts, stops = word_bounds(data, ends, letters)
    found = mix(Buffer(data).at(starts, stops) + (stops - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return found, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
