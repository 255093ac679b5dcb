import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import decontaminate as D


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 5), max_size=25))
def test_common_subsequence_against_table(item, words):
    table = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(words):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert D.common_subsequence(np.array(item), np.array(words, np.int64)) == table[-1][-1]


def _tables(spark, block_words=20):
    r = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    rare = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    word = lambda: r.choice(common) if r.random() < 0.5 else rare()
    items = [(i, " ".join(word() for _ in range(r.randrange(15, 50))).capitalize() + ". " + " ".join(rare() for _ in range(4)) + ".") for i in range(30)]
    vocabulary = [w.strip(".").lower() for _, t in items for w in t.split()]
    rows, want = [], {}
    for i in range(300):
        text = [r.choice(vocabulary) if r.random() < 0.2 else word() for _ in range(r.randrange(0, 200))]
        want[i] = set()
        if i % 6 == 0:
            k, t = items[r.randrange(30)]
            leak = t.split()
            if i % 12 == 0:  # a paraphrase: some words replaced or left out, the answer stays
                for _ in range(len(leak) // 4):
                    leak[r.randrange(len(leak) - 4)] = rare()
                if len(leak) > 20:
                    del leak[r.randrange(10)]
            at = r.randrange(len(text) + 1)
            text[at:at] = leak
            want[i] = {k}
        rows.append((i, " ".join(text)))
    return items, rows, want


def test_planted_items_are_found_and_clean_texts_are_left_alone(spark):
    items, rows, want = _tables(spark)
    benchmark = spark.createDataFrame([*items, (99, None), (98, " .,"), (None, items[0][1])], "item_id long, text string")
    docs = spark.createDataFrame([(*x, 7) for x in [*rows, (None, items[3][1].upper()), (500, None), (501, "")]], "doc_id long, text string, item_ids int").repartition(4)
    for block in (256, 7):
        got = {g.doc_id: g for g in D.find_leaks(docs, benchmark, block=block).collect()}
        assert {i: set(got[i].item_ids) for i in want} == want
        assert got[None].item_ids == [3] and got[None].best_overlap == 1.0
        assert not got[500].contaminated and got[501].n_words == 0


def test_empty_tables(spark):
    items, rows, _ = _tables(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string")
    assert D.find_leaks(docs.limit(0), benchmark).count() == 0
    assert D.find_leaks(docs, benchmark.limit(0)).where("not contaminated").count() == 5


def test_items_of_common_words_only_are_found(spark):
    r = random.Random(1)
    words = [f"c{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = "c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 c0 c3 c5 c7 c1 c2 c8 c9 c0"
    docs = spark.createDataFrame([(i, text(60) + (" " + item if i == 3 else "")) for i in range(200)], "doc_id long, text string")
    got = D.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), overlap=0.95).where("contaminated").collect()
    assert [g.doc_id for g in got] == [3]


def test_a_paraphrase_in_many_texts_does_not_hide_itself(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(28)) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(5)]
    leak = items[2][1].split()
    for at in r.sample(range(28), 8):  # 75 % of the words are kept
        leak[at] = word()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for rows, copies in ((300, 100), (4, 2)):
        texts = [[word() for _ in range(100)] for _ in range(rows)]
        for t in texts[:copies]:
            at = r.randrange(100)
            t[at:at] = leak
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {g.doc_id: g.item_ids for g in D.find_leaks(docs, benchmark).collect()}
        assert got == {i: [2] if i < copies else [] for i in range(rows)}


def test_a_paraphrase_with_a_short_answer_is_found(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    body = [word() for _ in range(20)]
    items = [(1, " ".join(body) + ". Ja."), (2, " ".join(body[::-1]) + "? Gamma Delta. ?!")]
    clean = [word() for _ in range(40)]
    half = lambda words: [w if i % 5 < 3 else word() for i, w in enumerate(words)]
    texts = [
        ([*clean, *half(body), "ja", *clean], [1]), ([*clean, *half(body), *clean], []), (["ja", *clean, *half(body), *clean], []),
        ([*half(body[::-1]), "gamma", "delta"], [2]), ([*half(body[::-1]), "gamma", *clean, "delta"], []),
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: g.item_ids for g in D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}
