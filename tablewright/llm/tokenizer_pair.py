"""Two public tokenizers, byte-level and piece-based, with the bytes of every token."""

from __future__ import annotations

import json

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# The bytes that a byte-level vocabulary shows as themselves; the others follow in order from U+0100.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Fixed value: the pattern of the byte-level pre-tokenizer, where the file names none.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def number_kind(size: int) -> str:
    """Little-endian integers wide enough for ids below ``size``."""
    return "<u2" if size <= 65536 else "<u4"


class ByteLevel:
    """Encoder of a byte-level file: the strings of special tokens are plain text.

    Where the file's merges are in the order of their ids, and its pre-tokenizer
    is the plain one, the same merges are run from the ranks, which is faster.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        special = {x["content"] for x in data.get("added_tokens", [])}
        hidden = [b for b in range(256) if b not in set(_SHOWN)]
        byte = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in data["model"]["vocab"].items() if token not in special}
        self.size = max(data["model"]["vocab"].values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, self.size)
        self._ranks = self._whole = None
        if _plain(data):
            self._ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self._whole = Tokenizer.from_file(path)
            self._whole.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self._ranks is not None:
            return np.array(self._ranks.encode_ordinary(text), np.int64)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int64)


def _plain(data: dict) -> bool:
    """Whether merging by id does what the file says."""
    step, model = data.get("pre_tokenizer") or {}, data["model"]
    if data.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or step.get("use_regex") is False:
        return False
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ids = [model["vocab"].get("".join(x)) for x in pairs]
    return model.get("type", "BPE") == "BPE" and not model.get("ignore_merges") and ids == list(range(256, 256 + len(ids)))


class Pieces:
    """Encoder of a piece model that puts a space before a text; the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.tokens = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, self.size)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


_loaded: dict[tuple[type, str], ByteLevel | Pieces] = {}


def loaded(kind: type, path: str) -> ByteLevel | Pieces:
    """One encoder per worker process and file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
