import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def frame(spark, rows, name="doc_id", **more):
    extra = "".join(f", {c} string" for c in more)
    return spark.createDataFrame([(*r, *more.values()) for r in rows], f"{name} long, text string{extra}")


def made(r, n):
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "naïve", "漢字", "x1"]
    topics = [[r.choice(vocabulary) for _ in range(8)] for _ in range(6)]

    def words():
        topic = r.choice(topics)
        return " ".join(r.choice(topic) if r.random() < 0.7 else r.choice(vocabulary[: 1 + int(60 * r.random() ** 2)]) for _ in range(r.randint(0, 40)))

    return [(k, words()) for k in range(n)], [(k, words()) for k in range(12)]


def ranked(spark, docs, items, **options):
    return sorted((tuple(x) for x in lexical.rank(docs, items, **options).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = made(random.Random(4), 700)
    docs += [(9001, None), (9002, ""), (9003, "!!! ..."), (9004, "w1 W2-w3"), (9005, "w1 W2-w3"), (9004, "w1 W2-w3"), (None, "w1 W2-w3"), (9006, "w1 " * 50_000)]
    items += [(50, None), (51, ""), (52, "w1 w2 w3"), (52, "w1 w2 w3"), (None, "w5 w6"), (53, "nowhere at all")]
    got = ranked(spark, frame(spark, docs, _id="x", _n="x", rank="x").repartition(5), frame(spark, items, "item_id", score="x"))
    assert got == brute(docs, items)
    assert got == ranked(spark, frame(spark, docs), frame(spark, items, "item_id"), block=3)


def test_copies_that_tie(spark):
    docs = [(k, "alpha beta" if k % 3 else "gamma delta") for k in range(400, 0, -1)]
    items = [(1, "alpha gamma"), (2, "beta")]
    assert ranked(spark, frame(spark, docs), frame(spark, items, "item_id"), top=5) == brute(docs, items, 5)


def test_a_term_of_all_documents_has_no_weight(spark):
    docs = [(k, "every one" if k else "every") for k in range(3000)]
    got = ranked(spark, frame(spark, docs), frame(spark, [(1, "every")], "item_id"))
    assert got == brute(docs, [(1, "every")])


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_tables(spark, docs, items):
    got = lexical.rank(frame(spark, docs), frame(spark, items, "item_id"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def segment_of(docs, items):
    vocabulary = sorted({w for _, t in items for w in terms(t)})
    place = {w: k for k, w in enumerate(vocabulary)}
    asked = lexical.Items([i for i, _ in items], np.arange(len(vocabulary)), [np.array(sorted({place[w] for w in terms(t)}), np.int64) for _, t in items])
    counted = [Counter(terms(t)) for _, t in docs]
    frequency = np.array([sum(w in c for c in counted) for w in vocabulary])
    counts = lexical.Statistics(sum(bool(c) for c in counted), sum(sum(c.values()) for c in counted), frequency)
    how = lexical.plan(asked, counts, np.arange(len(items)))
    column = lexical._columns(how.used, len(vocabulary))
    postings = [(k, column[place[w]], counts.impacts(np.array([place[w]]), np.array([n]), np.array([sum(c.values())]))[0])
                for k, c in enumerate(counted) for w, n in c.items() if w in place and column[place[w]] >= 0]
    text, term, impact = (np.array(x, np.int64) for x in zip(*postings))
    return lexical.Segment(np.array([i for i, _ in docs]), text, term, impact, how), how


def test_bounds_hold_and_blocks_are_skipped():
    docs, items = made(random.Random(8), 3000)
    segment, how = segment_of(docs, items)
    for term, found in zip(segment.lists, segment.bounds):
        for item, block, bound in zip(*found):
            own, texts = how.terms[item], segment.block_at[block]
            assert (segment.matrix[texts, term] > 0).all()
            # Documents that share a rarer term with the item are found in that term's list.
            texts = texts[(segment.matrix[texts][:, own[own < term]] == 0).all(axis=1)]
            assert not len(texts) or segment.matrix[texts][:, own].sum(axis=1).max() <= bound
    best = lexical.Best(len(items), 10)
    pairs, visited = segment.search(best)
    assert 0 < visited < pairs / 2
    want = brute(docs, items)
    assert sorted(((items[k][0], r + 1, int(i), int(s)) for k in range(len(items)) for r, (i, s) in enumerate(zip(best.ids[k], best.scores[k]))), key=str) == want


def test_blocks_hold_what_is_alike():
    """Lists of two mixed topics are cut between them."""
    r = random.Random(2)
    sides = [[f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]]
    docs = [(k, "common " + " ".join(r.choice(sides[k % 2]) for _ in range(30))) for k in range(1200)]
    segment, how = segment_of(docs, [(1, "common " + " ".join(sides[0] + sides[1]))])
    wide = [b for b in segment.block_at if len(b) > 4]
    pure = [max(np.mean(b % 2), 1 - np.mean(b % 2)) for b in wide]
    assert np.mean(pure) > 0.95
