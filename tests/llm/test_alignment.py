import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import alignment
from tests.oracle import data_folder

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text, byte_level, pieces):
    """(id, first byte, end) of each token of A and of B, by the libraries' own encoders."""
    if not text:
        return [], []
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173) and not 127 <= b < 161]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    raw = (" " + text).encode()
    out = []
    got = byte_level.encode(" " + text, add_special_tokens=False)
    named = [(i, bytes(byte[c] for c in t)) for i, t in zip(got.ids, got.tokens)]
    ids = pieces.encode(text)
    spelled = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in ids for p in [pieces.id_to_piece(i)]]
    for side in (named, spelled):
        if b"".join(t for _, t in side) != raw:
            return [], []
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def brute(rows):
    byte_level = Tokenizer.from_file(A)
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    all_tokens = [tokens(t, byte_level, pieces) for _, t in rows]
    links = []
    for a, b in all_tokens:
        found, k = [], 0
        for i, start, end in a:
            while k < len(b) and b[k][2] <= start:
                k += 1
            found += [(i, j) for j, s, e in b[k : k + end - start] if s < end and e > start]
        links.append(found)
    count = Counter(x for found in links for x in found)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for (name, _), (a, b), found in zip(rows, all_tokens, links):
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)))
            low = high
        text = ";".join(groups)
        out.append((name, len(a), len(b), len(groups), len(found), sum(count[x] == most[x[1]] for x in found), sum(count[x] for x in found),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "tab\tand\nlines\n\n"), (6, "<|endoftext|> </s> <s> <unk>"), (7, "a▁b"),
    (8, "naïve Straße ﬁ ① 漢字 🙂👍🏽 é"), (9, "same text here"), (10, "same text here"), (10, "same text here"), (None, "no id"), (None, None),
    (11, "\x00\x01 control"), (12, "　 ​"), (13, "it's they'll WE'VE 12345 67!!??"), (14, "x" * 3000), (15, "word " * 4000),
]


def frame(spark, rows, **more):
    extra = "".join(f", {c} string" for c in more)
    return spark.createDataFrame([(*r, *more.values()) for r in rows], f"doc_id long, text string{extra}")


@pytest.mark.parametrize("most", [2_000_000, 0], ids=["broadcast", "join"])
def test_against_brute_force(spark, most):
    r = random.Random(3)
    letters = list("abcdeßñ  \n.,'1<|>é漢") + [" the", "ing ", "tion"]
    rows = ODD + [(100 + k, "".join(r.choice(letters) for _ in range(r.randint(0, 120)))) for k in range(150)]
    docs = frame(spark, rows, _a="x", _pair="x", n="x", best="x").repartition(3)
    got = alignment.align(docs, A, B, most_pairs=most)
    assert got.columns == COLUMNS
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_groups_that_are_joined_are_many(spark, monkeypatch):
    rows = [(k, f"repeat after me number {k % 3}, the same words") for k in range(60)]
    docs = frame(spark, rows).coalesce(1)
    monkeypatch.setattr(alignment, "_GROUP", 30)
    assert sorted((tuple(x) for x in alignment.align(docs, A, B, most_pairs=0).collect()), key=str) == brute(rows)


def test_table_of_documents(spark):
    docs = spark.read.parquet(f"{data_folder('0.001')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 8000]
    got = alignment.align(docs.where("length(text) < 8000"), A, B)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    got = alignment.align(frame(spark, []), A, B)
    assert got.columns == COLUMNS and got.collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same(size):
    r = np.random.default_rng(size)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a, b = (np.append(np.flatnonzero(r.random(n) < r.random()) + 1, n + 1) for _ in range(2))
        i, j, closes = alignment.overlaps(a, b, size)
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts[0][x] < b[y] and starts[1][y] < a[x]]
        assert list(zip(i.tolist(), j.tolist())) == want
        assert closes.tolist() == [a[x] == b[y] for x, y in want]


def test_diagonals_split_the_work_evenly():
    r = np.random.default_rng(5)
    a, b = (np.unique(r.integers(1, 9999, n)) for n in (300, 2000))
    i, j = alignment.merge_path(a, b, 64)
    assert (np.diff(i + j)[:-1] == 64).all() and i[-1] == len(a) and j[-1] == len(b)
    for x, y in zip(i, j):
        assert x == 0 or y == len(b) or a[x - 1] <= b[y]
        assert y == 0 or x == len(a) or b[y - 1] < a[x]


def test_groups_of_a_text():
    (groups,) = alignment.align_texts(["unbelievable things"], A, B)
    assert [i for a, _ in groups for i in a] and [i for _, b in groups for i in b]
    assert alignment.align_texts([""], A, B) == [[]]
