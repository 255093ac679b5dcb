import math
import random

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import lm_scoring as L
from tablewright.llm import token_counts as C
from tablewright.llm.bytebpe import encoder

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(ends, sections, rule):
    out, crossing = [0.0] * len(sections), [0] * len(sections)
    start = 0
    for end in ends:
        over = [max(0, min(end, b) - max(start, a)) for a, b in sections]
        for i, o in enumerate(over):
            crossing[i] += 0 < o < end - start
        if sum(over):
            if rule == "share":
                for i, o in enumerate(over):
                    out[i] += o / sum(over)
            elif rule == "largest":
                out[over.index(max(over))] += 1
            else:
                at = start if rule == "start" else end - 1
                for i, (a, b) in enumerate(sections):
                    out[i] += a <= at < b
        start = end
    return out, crossing


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 6)), max_size=8), st.sampled_from(C.RULES))
def test_allocation_against_brute_force(lengths, gaps, rule):
    ends, at, sections = np.cumsum(np.array(lengths, np.int64)), 0, []
    for gap, n in gaps:
        sections.append((at + gap, at + gap + n))
        at += gap + n
    got, crossing = C.allocate(ends, np.array([a for a, _ in sections], np.int64), np.array([b for _, b in sections], np.int64), rule)
    want, want_crossing = brute(ends.tolist(), sections, rule)
    assert np.allclose(got, want) and list(crossing) == want_crossing


def test_sections_and_fields(spark):
    texts = [None, "", "\n\n", "one line", "Ünïcode 😀\n\n\nlines  \n with more\n", "a" * 5000 + "\n" + "b c" * 3000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    coder = encoder(PATH, P.PATTERN)
    for rule in C.RULES:
        got = C.count_sections(docs, PATH, P.PATTERN, rule=rule).collect()
        for i, t in enumerate(texts):
            mine = [g for g in got if g.doc_id == (i if i != 3 else None)]
            assert "".join(t[g.start_char : g.end_char] for g in sorted(mine, key=lambda g: g.start_char)) == (t or "") if t else not mine
            if t:
                assert math.isclose(sum(g.n_tokens for g in mine), len(coder.encode(t))) and {g.doc_tokens for g in mine} == {len(coder.encode(t))}
    pages = spark.createDataFrame([(1, "http://x", "née <p>"), (2, None, "y"), (3, "", None)], "page_id long, url string, html string")
    got = {(g.page_id, g.section): g for g in C.count_fields(pages, ["url", "html"], PATH, P.PATTERN, id="page_id", between="").collect()}
    assert set(got) == {(1, "url"), (1, "html"), (2, "html")}
    assert got[1, "url"].n_tokens + got[1, "html"].n_tokens == len(coder.encode("http://xnée <p>"))
    assert C.count_sections(docs.limit(0), PATH, P.PATTERN).count() == 0


def _corpus(spark):
    r = random.Random(3)
    good, odd = [f"word{i}" for i in range(40)], [f"#{i}|" for i in range(40)]
    rows = []
    for i in range(400):
        pool = good if i % 3 else odd
        rows.append((i, " ".join(r.choice(pool) for _ in range(r.randrange(5, 80)))))
    docs = spark.createDataFrame([(*x, "d") for x in [*rows, (900, None), (901, ""), (None, "word1 word2")]], "doc_id long, text string, difference string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    return rows, docs, labels


def test_difference_follows_the_target(spark):
    rows, docs, labels = _corpus(spark)
    models = L.fit(docs, labels, PATH, P.PATTERN)
    got = {g.doc_id: g for g in L.score(docs, models, PATH, P.PATTERN).collect()}
    unseen = [i for i, _ in rows if i % 2]
    assert all(got[i].selected == bool(i % 3) for i in unseen)
    assert got[900].n_tokens == 0 and got[900].target_loss is None and got[901].selected is False and got[None].n_tokens > 0
    assert L.score(docs.limit(0), models, PATH, P.PATTERN).count() == 0


def test_counts_and_losses_against_brute_force(spark):
    rows, docs, labels = _corpus(spark)
    coder = encoder(PATH, P.PATTERN)
    models = L.fit(docs, labels, PATH, P.PATTERN, weight=3.0)
    unigrams, pairs = [{}, {}], [{}, {}]
    for i, t in [*rows, (None, "word1 word2"), (900, ""), (901, "")]:
        ids = [coder.size, *coder.encode(t).tolist()]
        for k in (0, 1):
            if k or i is not None and i % 2 == 0 and i < 400 and i % 3:
                for a in ids:
                    unigrams[k][a] = unigrams[k].get(a, 0) + 1
                for a, b in zip(ids, ids[1:]):
                    pairs[k][a, b] = pairs[k].get((a, b), 0) + 1
    scale = sum(unigrams[0].values()) / sum(unigrams[1].values())
    probe = rows[7][1]
    ids = [coder.size, *coder.encode(probe).tolist()]
    for k, factor in ((0, 1.0), (1, scale)):
        total = 0.0
        for a, b in zip(ids, ids[1:]):
            one = (unigrams[k].get(b, 0) * factor + 1) / (sum(unigrams[k].values()) * factor + coder.size + 1)
            total -= math.log((pairs[k].get((a, b), 0) * factor + 3 * one) / (unigrams[k].get(a, 0) * factor + 3))
        assert math.isclose(models.losses(np.array(ids[1:]), coder.size)[k], total / (len(ids) - 1), rel_tol=0.02)
    alone = L.fit(docs, labels.limit(0), PATH, P.PATTERN)
    assert {g.difference for g in L.score(docs, alone, PATH, P.PATTERN).collect()} == {0.0, None}


def test_many_different_bigrams_are_counted_exactly(spark):
    r = np.random.default_rng(5)
    coder = encoder(PATH, P.PATTERN)
    words = ["".join(w) for w in r.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 5)).tolist()]
    texts = [" ".join(r.choice(words, 1000).tolist()) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = {g.doc_id: g for g in L.score(docs, L.fit(docs, labels, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    ids = [[coder.size, *coder.encode(t).tolist()] for t in texts]
    unigrams, pairs = [{}, {}], [{}, {}]
    for i, x in enumerate(ids):
        for k in (0, 1) if i % 2 else (1,):
            for a in x:
                unigrams[k][a] = unigrams[k].get(a, 0) + 1
            for p in zip(x, x[1:]):
                pairs[k][p] = pairs[k].get(p, 0) + 1
    n = [sum(u.values()) for u in unigrams]
    assert len(got) == 200 and len(pairs[1]) > 80_000
    for i in (3, 4):
        for k, name, scale in ((0, "target_loss", 1.0), (1, "background_loss", n[0] / n[1])):
            total = 0.0
            for a, b in zip(ids[i], ids[i][1:]):
                one = (unigrams[k].get(b, 0) * scale + 1) / (n[k] * scale + coder.size + 1)
                total -= math.log((pairs[k].get((a, b), 0) * scale + 200 * one) / (unigrams[k].get(a, 0) * scale + 200))
            assert math.isclose(got[i][name], total / (len(ids[i]) - 1), rel_tol=1e-9)
