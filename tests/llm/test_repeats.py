import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tablewright.llm import repeats


def brute(texts, width):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, r in enumerate(raws):
        for j in range(len(r) - width + 1):
            seen.setdefault(r[j : j + width], []).append((i, j))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + width] = True
    out = []
    for r, g in zip(raws, gone):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((len(r), int(g.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~g])).hexdigest()))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "ñu", "rho", "s", "tau"]
    make = lambda k: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(k))
    shared, line = make(60), "common line " * 6
    out = [None, "", "short", "a" * 900, "ab" * 400, shared, shared, *["xy z" * 90] * 5, *[make(70)] * 4]
    for i in range(n):
        t = make(r.randrange(5, 150))
        if i % 3 == 0:
            t = t[:50] + line + t[50:]
        if i % 4 == 0:
            at = r.randrange(0, 200)
            t = t + shared[at : at + r.randrange(100, 400)] + make(3)
        if i % 5 == 0:
            out.append(t.replace("alpha1", "changed"))
        if i % 9 == 0:
            t = t + make(2) + t
        out.append(t)
    return out


@pytest.mark.parametrize("crowd,segment", [(1 << 15, 1 << 20), (2, 1 << 20), (1 << 15, 1500)])
def test_repeats_against_brute_force(spark, monkeypatch, crowd, segment):
    monkeypatch.setattr(repeats, "_SEGMENT", segment)
    found = texts(crowd)
    if segment < 1 << 20:  # workers import the module anew: the long text is made long enough instead
        found.append("".join(chr(97 + (i * i * 7 + i // 50) % 26) for i in range((1 << 20) + 5000)) + found[10])
        assert [x for k, x in enumerate(repeats._segments([b"x" * 4000], np.array([1]), 200)) if k == 2]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(5)
    got = repeats.remove_repeats(docs, crowd=crowd).collect()
    key = lambda t, x: (str(t), *x)
    want = sorted(key(t, x) for t, x in zip(found, brute([t if t and len(t) < 1 << 20 else t for t in found], 200)))
    assert sorted(key(g.text, (g.n_bytes, g.n_removed, g.n_spans, hashlib.sha256(bytes(g.kept)).hexdigest())) for g in got) == want
    assert got[0].__fields__ == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]


def test_repeats_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0


def test_settle_does_not_depend_on_batches():
    r = random.Random(3)
    rows = sorted((r.randrange(6), r.randrange(5), r.randrange(4), r.randrange(3)) for _ in range(300))
    pdf = pd.DataFrame(rows, columns=["anchor", "span", "doc", "place"]).assign(weight=1)
    for crowd in (1, 3, 100):
        whole = pd.concat(list(repeats.settle(crowd)(iter([pdf]))))
        for size in (1, 2, 7, 50):
            parts = pd.concat(list(repeats.settle(crowd)(pdf.iloc[i : i + size] for i in range(0, len(pdf), size))))
            sort = lambda x: sorted(map(tuple, x.drop_duplicates().to_numpy().tolist()))
            assert sort(parts[parts.kind == 0]) == sort(whole[whole.kind == 0])
            asked = lambda x: {(a, d, p, bool(k)) for a, d, p, k in x[x.kind > 0][["anchor", "doc", "place", "known"]].itertuples(index=False)}
            assert asked(parts) == asked(whole)


def test_combining_keeps_runs_apart_and_cuts_long_ones(monkeypatch):
    monkeypatch.setattr(repeats, "_LONGEST", 300)
    texts = [b"ab" * 500, b"ab" * 400, b"q" * 250 + bytes(range(48, 120)) * 4]
    keys = np.array([5, -3, 9])
    found = repeats.anchors(texts, keys, np.zeros(3, np.int64), 200)
    got = repeats.combine(found, np.ones(len(found["doc"]), np.int64))
    covered = {int(k): set() for k in keys}
    start, length = repeats.unpack(got["place"])
    for d, a, n, w in zip(got["doc"], start, length, got["weight"]):
        if w == 0:
            assert n <= 300
            covered[int(d)] |= set(range(a, a + n))
    assert covered[5] == set(range(1000)) and covered[-3] == set(range(800))
    assert set(got["weight"].tolist()) <= {0, 1, 2}
