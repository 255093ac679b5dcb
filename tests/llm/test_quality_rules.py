import random
import re

import numpy as np

from tablewright.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_statistics_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "\x0ba\x0cb\rc\x1cd\x85e  f", "x\nx\n x\nx ", "# $ é 😀 😀"]
    for _ in range(60):
        words = ["a", "b", "c", "é", "😀|", "##", "long" * 5]
        texts.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "\t "]) for _ in range(r.randrange(1, 160))))
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rule string")
    got = {g.doc_id: g for g in Q.judge_quality(docs, []).collect()}
    for i, t in enumerate(texts):
        g = got[i if i else None]
        want = brute(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want, (i, t)
        assert g.kept == (not want[-1]) and g.rule is None
    assert Q.judge_quality(docs.limit(0), []).count() == 0


def test_learned_list_finds_the_planted_conjunction():
    r = np.random.default_rng(1)
    x = {k: r.random(3000) for k in Q.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) & (x["words"] < 0.5) | (x["repeated_words"] > 0.9)
    rules = Q.learn(x, bad)
    covered = np.any([rule.covers(x) for rule in rules], axis=0)
    assert (covered & bad).sum() > 0.95 * bad.sum()
    assert (covered & ~bad).sum() < 0.02 * (~bad).sum()
    assert Q.learn(x, np.zeros(3000, bool)) == [] and Q.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_rules_as_columns_agree_with_numpy(spark):
    rules = [Q.Rule((("symbols_per_word", True, 0.5), ("words", False, 60.0))), Q.Rule((("duplicate_lines", True, 0.25),))]
    texts = ["word " * 55, "w # " * 28, "a\n" * 60, "one two three\n" * 2 + " ".join(map(str, range(60)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = Q.with_statistics(docs).selectExpr("doc_id", *(f"{v} AS {k}" for k, v in Q.FEATURES.items())).orderBy("doc_id").collect()
    x = {k: np.array([s[k] for s in stats], float) for k in Q.FEATURES}
    first = [next((i for i, rule in enumerate(rules) if rule.covers(x)[d]), None) for d in range(len(texts))]
    assert [g.rule for g in Q.judge_quality(docs, rules).orderBy("doc_id").collect()] == first


def test_learning_from_tables_keeps_good_texts(spark):
    r = random.Random(5)
    good = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    rows = [(i, good() if i % 3 else good().replace(" ", " ### "), 1 if i % 3 else 0) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(1, None), (None, 0), (2, 7)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    got = {g.doc_id: g.kept for g in Q.judge_quality(docs, rules).collect()}
    assert all(got[i] == bool(q) for i, _, q in rows)
