"""Byte-level tokenizers whose tokens, put together, are the text's bytes."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

_loaded: dict[tuple[str, str], ByteEncoder] = {}


class ByteEncoder:
    """Whole-text encoding from a file of ranks, and how many bytes each token has."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.int64)


def encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder per worker process and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteEncoder(path, pattern)
    return _loaded[path, pattern]
