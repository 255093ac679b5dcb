"""Encoding whole texts by a tokenizer that drops white space, one different word at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .texthash import Buffer, U, mix

LOT = 20_000  # words that the tokenizer gets in one text: it takes about a kilobyte for each until their ids are read

_loaded: dict[str, WordEncoder] = {}
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of bytes between blanks and line breaks."""
    edge = np.diff(_BREAK[data].astype(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, stops, mix(Buffer(data).at(starts, stops) + (stops - starts).astype(U) * U(0x9FB21C651E98DF25))


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    For tokenizers whose pre-tokenizer never crosses white space and drops it:
    the different words of a batch are encoded together in one text, and each
    text's ids are put together from theirs.  What is known of a word is kept
    by its 64-bit hash for later batches, up to ``most`` words.  ASCII words are
    encoded in lower case, and a full stop or comma after a letter is a token of
    its own, so a word is encoded once however it is written.
    """

    def __init__(self, path: str, most: int = 2_000_000) -> None:
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys, self.rows = np.zeros(0, U), np.zeros(0, np.int64)
        self.begins, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.rows[place], self.keys[place] == keys

    def _add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        rows = np.arange(len(keys)) + len(self.begins)
        self.begins = np.concatenate([self.begins, np.cumsum(counts) - counts + len(self.ids)])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids.astype(np.int32)])
        place = np.searchsorted(self.keys, keys, "right")  # both are sorted
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, rows)

    def _ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of those words one after the other, and where each word's end."""
        counts = self.counts[rows]
        stops = np.cumsum(counts)
        return self.ids[np.arange(int(counts.sum())) + np.repeat(self.begins[rows] - (stops - counts), counts)], stops

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        ends = [w[-1] if w[-1] in ".," and len(w) > 1 and w[-2].lower().isalpha() else "" for w in words]
        stems = [w[: len(w) - len(e)] for w, e in zip(words, ends)]
        stems = [w.lower() if w.isascii() and "<|" not in w else w for w in stems]  # special tokens keep their case
        stem_keys = _words(np.frombuffer("\n".join([*stems, ".", ","]).encode(), np.uint8))[2]
        different, first = np.unique(stem_keys, return_index=True)
        new = np.flatnonzero(~self._find(different)[1])
        self._encode([(stems[i] if i < len(stems) else ".,"[i - len(stems)]) for i in first[new].tolist()], different[new])
        # A word is its stem and what follows it; words that are stems themselves are known by now.
        more = np.flatnonzero(~self._find(keys)[1])
        stem = self._find(stem_keys[:-2][more])[0]
        follows = np.array([0 if not e else 1 + ".,".index(e) for e in ends], np.int64)[more]
        end = self._find(stem_keys[-2:])[0][np.maximum(follows - 1, 0)]
        rows = np.stack([stem, end], axis=1).ravel()
        used = np.stack([np.ones(len(more), bool), follows > 0], axis=1).ravel()
        counts = np.where(used, self.counts[rows], 0)
        self._add(keys[more], counts.reshape(-1, 2).sum(axis=1), self._ids_of(rows[used])[0])

    def _encode(self, words: list[str], keys: np.ndarray) -> None:
        for a in range(0, len(words), LOT):
            self._encode_lot(words[a : a + LOT], keys[a : a + LOT])

    def _encode_lot(self, words: list[str], keys: np.ndarray) -> None:
        plain = np.array([w.isalpha() and (w.isascii() or w.islower() and unicodedata.is_normalized("NFC", w)) for w in words], bool)
        letters = [w for w, p in zip(words, plain.tolist()) if p]
        if letters:  # one pre-token each, so a word ends where a token has the end-of-word mark
            ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(letters):
                self._add(keys[plain], np.diff(stops, prepend=0), ids)
            else:
                plain[:] = False
        rest = [w for w, p in zip(words, plain.tolist()) if not p]
        if rest:
            self._encode_by_offsets(rest, keys[~plain])

    def _encode_by_offsets(self, words: list[str], keys: np.ndarray) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found))
        # A token's offsets can begin at the blank before its word, never at the one after it.
        starts = np.zeros(int(first[-1]) + 2, bool)
        starts[first] = True
        at = np.where(starts[np.minimum(at + 1, len(starts) - 1)], at + 1, at)
        word = np.searchsorted(first, at, "right") - 1
        self._add(keys, np.bincount(word, minlength=len(words)).astype(np.int64), np.array(found.ids, np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text begins (one entry more than texts)."""
        raws = [t.encode() for t in texts]
        joined = b" ".join(raws)
        starts, stops, keys = _words(np.frombuffer(joined, np.uint8))
        different, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        rows, known = self._find(different)
        if not known.all():
            if len(self.keys) + 2 * int((~known).sum()) > self.most:
                self._reset()
                known = np.zeros(len(different), bool)
            new = first[~known]
            self._learn([joined[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist())], different[~known])
            rows = self._find(different)[0]
        ids, ends = self._ids_of(rows[inverse])
        # A text's words begin after the bytes of the texts before it and a blank for each.
        at = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))])
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, at)]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
