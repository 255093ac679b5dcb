import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm import packing, wordbpe
from tablewright.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("aZé'st1́.,<|>endoftx \n\t \x1c\x85　ßİ한"), max_size=40), max_size=6))
def test_encoder_equals_whole_text_encoding(texts):
    coder, plain = _pair()
    ids, at = coder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


_made = []


def _pair():
    if not _made:
        _made.extend((WordEncoder(PATH, most=50), Tokenizer.from_file(PATH)))
    return _made


@pytest.mark.parametrize("name", ["<|endoftext|>", "a<|endoftext|>b c", "<|ENDOFTEXT|>.", "a. b, ., ,. é. É, 1. A.B.", "it's I'LL x'y 12a", "ＡＢ ﬁ é ́x"])
def test_encoder_on_odd_words(name):
    ids, _ = WordEncoder(PATH).encode([name, "x " + name + " y"])
    want = [i for t in (name, "x " + name + " y") for i in _pair()[1].encode(t, add_special_tokens=False).ids]
    assert ids.tolist() == want


def test_encoding_a_task_s_texts_takes_bounded_memory():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdeéñ") for _ in range(6)) for _ in range(r.randrange(200, 900))) for _ in range(1100)]
    coder, plain = WordEncoder(PATH), _pair()[1]
    tracemalloc.start()
    try:
        lengths = [len(x) for x in packing.documents_ids(coder, texts, 2)]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 3 << 20 and peak < 120
    for i in (0, 500, 1099):
        assert lengths[i] == len(plain.encode(texts[i], add_special_tokens=False).ids) + 1


def test_the_tokenizer_gets_a_lot_of_words_at_a_time(monkeypatch):
    monkeypatch.setattr(wordbpe, "LOT", 3)
    coder, seen = WordEncoder(PATH), []

    class Told:
        def encode(self, text, **options):
            seen.append(len(text.split()))
            return _pair()[1].encode(text, **options)

    coder.tokenizer = Told()
    text = "one two three four five x-1 y-2 z-3, w-4. Ñandú a.b c.d"
    ids, _ = coder.encode([text])
    assert ids.tolist() == _pair()[1].encode(text, add_special_tokens=False).ids
    assert max(seen) <= 3


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([7, 16, 50]))
def test_best_fit_takes_the_tightest_window(lengths, size):
    lengths = np.array([1 + x % size for x in lengths], np.int64)
    window, offset, filled = packing.best_fit_decreasing(lengths, size)
    left = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in left if c >= lengths[i]]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - lengths[i])
        else:
            left.append(size - lengths[i])
    assert sorted(size - filled) == sorted(left)
    assert all(filled <= size)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_layout_places_every_id_once(totals):
    x = packing.layout(np.array(totals, np.int64), 64)
    seen = {}
    for d, s, n in zip(x["doc"], x["start"], x["length"]):
        seen.setdefault(int(d), []).extend(range(s, s + n))
    assert {k: sorted(v) for k, v in seen.items()} == {i: list(range(n)) for i, n in enumerate(totals)}
    for w in set(x["window"].tolist()):
        mine = sorted((int(o), int(n)) for o, n, v in zip(x["offset"], x["length"], x["window"]) if v == w)
        at = 0
        for o, n in mine:
            assert o == at
            at += n
        assert at & (at - 1) == 0 or 64 - at <= 4 and at <= 64


def test_pack_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", " \n "] + [" ".join(r.choice(["the", "Ñandú", "of", "x1", "well,"]) for _ in range(r.randrange(1, 9000))) for _ in range(30)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    got = packing.pack(docs, PATH, ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    want = {(i if i != 5 else None): plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    whole = {}
    sequences = {}
    for p in sorted(got, key=lambda p: p.start):
        assert p.start == len(whole.setdefault(p.doc_id, []))
        whole[p.doc_id] += p.ids
        assert p.length == len(p.ids) and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert whole == want
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        used += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded < 0.05 * used
    assert packing.pack(docs.limit(0), PATH).count() == 0
