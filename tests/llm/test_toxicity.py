import random
import zlib

from tablewright.llm import toxicity as T


def _tables(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic = i % 4 == 0
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["scoundrel", "blockhead", "nitwit"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(*x[:2], "1") for x in rows] + [(5000, None, ""), (5001, "", ""), (None, "a nitwit", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(3, 1), (None, 1), (5000, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_rows_and_misspellings(spark):
    rows, docs, labels = _tables(spark)
    model = T.fit(docs, labels)
    got = {g.doc_id: g for g in T.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + 3
    out = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    assert got[None].held_out is False and 0 <= got[None].score <= 1
    odd = model.score(["mida lomi the scoundrell tepo", "mida lomi tepo"], {})
    assert odd[0] > 0.5 > odd[1]


def test_fits_do_not_depend_on_held_out_labels(spark):
    rows, docs, labels = _tables(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = T.fit(docs, labels, per_class=50), T.fit(docs, flipped, per_class=50)
    assert a.bias == b.bias and (a.weight == b.weight).all()


def test_empty_tables_and_one_class(spark):
    _, docs, labels = _tables(spark)
    assert T.score_toxicity(docs.limit(0), T.fit(docs, labels.limit(0))).count() == 0
    assert {g.score for g in T.score_toxicity(docs, T.fit(docs, labels.limit(0))).collect()} == {0.5}
    only = T.fit(docs, labels.where("toxic = 0"))
    assert all(g.predicted == 0 for g in T.score_toxicity(docs, only).collect())


def test_long_runs_are_read_to_their_end(spark):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    for n in (1, 63, 64, 65, 66, 124, 125, 126, 185, 1000):
        run = letters(n)
        whole = f"<{run}>"
        want = {zlib.crc32(whole[i : i + k].encode()) % (1 << 30) for k in (3, 4, 5) for i in range(len(whole) - k + 1)}
        got = set().union(*(T.grams(w, 1 << 30) for w in T.words_of(run)))
        assert want <= got and (n > 64 or T.words_of(run) == [run])
    _, docs, labels = _tables(spark)
    model = T.fit(docs, labels)
    neutral = "mida" * 30
    plain, hidden, begun = model.score([neutral + "tepolomi" * 3, neutral + "scoundrel" * 3, "scoundrel" * 3 + neutral], {})
    assert hidden > plain and begun > plain
