import random

import numpy as np

from tablewright.llm import near_dups
from tablewright.llm.components import components


def shingles(text, k=5):
    raw = (text or "").encode().lower().split()
    return {tuple(raw[i : i + k]) for i in range(len(raw) - k + 1)} if len(raw) >= k else ({tuple(raw)} if raw else set())


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, len(shingles(t)), top(i) if i is not None else None, i is None or top(i) == i) for i, t in rows), key=str)


def sample(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Émile", "naïve", "x y"]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, texts = [], []
    for _ in range(25):
        base = make(r.choice([3, 6, 12, 40, 120]))
        texts.append(base)
        for _ in range(r.randrange(0, 8)):
            other = list(base)
            for _ in range(r.randrange(0, 4)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            texts.append(other)
    for i, words in enumerate(texts):
        sep = r.choice([" ", "\n", " \t"])
        rows.append((i * 3 % 101 if i % 40 else None, sep.join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in words)))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, rows[1][1]), (5003, rows[1][1]), (5004, "one two"), (5005, "one two"), (-7, "One TWO")]
    return rows


def test_components_against_brute_force(spark):
    for percent, seed in ((85, 1), (80, 2)):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(4)
        got = near_dups.near_duplicates(docs, percent=percent).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_no_documents(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_later_hubs_find_links_that_the_first_hub_hides(spark):
    # All variants of one text share buckets, but only neighbours are similar enough.
    r = random.Random(4)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(words)))
        words[r.randrange(200)] = f"n{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(docs, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 85)


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 7), (1, 120), (3, 2)], "a long, b long")
    got = {x.id: x.component for x in components(links).collect()}
    assert got == {**{i: 1 for i in range(100, 141)}, 1: 1, 2: 2, 3: 2}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    begins, detours = near_dups._layout(200)
    a = r.integers(0, 2**64, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], r.integers(0, 2**64, 40, dtype=np.uint64)])
    same = near_dups.signature(np.unique(a), begins, detours) == near_dups.signature(np.unique(b), begins, detours)
    assert abs(same.mean() - 360 / 440) < 0.12


def test_texts_of_one_template_do_not_meet(spark):
    # 400 words of a template and 40 own ones: 0.82 alike, so nothing links at 0.85.
    r = random.Random(8)
    template = [f"t{i}" for i in range(400)]
    met = {}
    original = near_dups._meetings

    def counted(postings, percent):
        x, y = original(postings, percent)
        met[size] = x.join(y, [near_dups.F.col(f"x.{k}") == near_dups.F.col(f"y.{k}") for k in near_dups._KEY]).count()
        return x, y

    near_dups._meetings = counted
    try:
        for size in (500, 1000):
            rows = []
            for i in range(size):
                at = r.randrange(400)
                rows.append((i, " ".join(template[:at] + [f"o{i}_{k}" for k in range(40)] + template[at:])))
            got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85)
            assert got.where("kept").count() == size
    finally:
        near_dups._meetings = original
    assert met[500] <= 500 and met[1000] <= 1000, met


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "_BLOCK", 3)
    for percent, seed in ((85, 3), (80, 5)):
        rows = sample(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = near_dups.near_duplicates(docs, percent=percent, bands=8, rows=2).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_copies_over_many_partitions(spark):
    rows = [(i, "one two three four five six seven" if i % 3 else f"own words of text number {i} only") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = near_dups.near_duplicates(docs, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 85)


def test_every_similar_pair_meets(spark):
    # All pairs of sets against the join by rarest shingles alone, whatever the buckets found.
    rows = [x for x in sample(9) if x[0] is not None and (x[1] or "").strip()]
    rows = list({i: (i, t) for i, t in rows}.values())
    texts = spark.createDataFrame(rows, "_id long, text string").selectExpr("_id", "text AS _text")
    members = texts.selectExpr("_id AS doc", "_id AS label")
    for percent in (60, 80, 95):
        got = {tuple(p) for p in near_dups._rare_shingle_pairs(texts, members, 5, percent).collect()}
        sets = {i: shingles(t) for i, t in rows}
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    assert (a, b) in got
