import math
import zlib

import numpy as np
import pytest

from tablewright.llm import byte_cnn
from tablewright.llm.byte_cnn import Network, Shape
from tests.oracle import data_folder

SMALL = Shape(chunk=24, step=17, width=4, stride=2, depth=3, filters=5, hidden=4)


def network(shape, seed=0):
    r = np.random.default_rng(seed)
    f = lambda *n: r.normal(0, 0.5, n).astype(np.float32)
    return Network(shape, f(257, shape.depth), f(shape.depth * shape.width, shape.filters), f(shape.filters), f(shape.filters, shape.hidden), f(shape.hidden), f(shape.hidden), 0.3)


def brute(net, text):
    """The same in plain loops."""
    s, pooled = net.shape, []
    starts = [0]
    while starts[-1] + s.chunk < len(text):
        starts.append(starts[-1] + s.step)
    for at in starts:
        chunk = [*text[at : at + s.chunk]]
        chunk += [256] * (s.chunk - len(chunk))
        best = [0.0] * s.filters
        for p in range(0, s.chunk - s.width + 1, s.stride):
            for f in range(s.filters):
                total = float(net.offset[f])
                for d in range(s.depth):
                    for w in range(s.width):
                        total += float(net.vectors[chunk[p + w], d]) * float(net.taps[d * s.width + w, f])
                best[f] = max(best[f], total)
        pooled.append(best)
    means = np.mean(pooled, axis=0)
    odds = sum(math.tanh(float(means @ net.inner[:, h] + net.lift[h])) * float(net.outer[h]) for h in range(s.hidden)) + net.bias
    return 1 / (1 + math.exp(-odds))


def test_score_against_plain_loops():
    net = network(SMALL)
    r = np.random.default_rng(1)
    texts = [b"", b"a", "naïve 漢字".encode(), b"x" * 24, b"y" * 25, b"z" * 41, b"w" * 42, *(bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (17, 100, 700))]
    assert np.allclose(net.score(texts), [brute(net, t) for t in texts], atol=1e-5)


def test_chunks_cover_every_byte():
    for n in range(0, 400):
        text = bytes(i % 251 for i in range(n))
        chunks = np.concatenate(list(byte_cnn.cut(text, SMALL, most=3)))
        assert len(chunks) == byte_cnn.count(n, SMALL)
        seen = {k * SMALL.step + i for k in range(len(chunks)) for i in range(SMALL.chunk) if chunks[k, i] != 256}
        assert seen == set(range(n))
        assert all(chunks[k, i] == text[k * SMALL.step + i] for k in range(len(chunks)) for i in range(SMALL.chunk) if chunks[k, i] != 256)


def test_a_long_text_is_scored_to_its_end(monkeypatch):
    net = network(SMALL)
    monkeypatch.setattr(byte_cnn, "_FEW", 8)
    text = bytes(i * 7 % 256 for i in range(5000))
    assert np.allclose(net.score([text, b"", text])[0], brute(net, text), atol=1e-5)
    assert abs(net.score([text + b"\xff\x00" * 600])[0] - net.score([text])[0]) > 1e-4


@pytest.mark.parametrize("name", ["vectors", "taps", "offset", "inner", "lift", "outer"])
def test_gradient_against_differences(name):
    r = np.random.default_rng(2)
    net = network(SMALL, 3)
    drawn = [r.integers(0, 257, (k, SMALL.chunk)) for k in (1, 3, 2)]
    labels = np.array([1, 0, 1])

    def loss(values):
        n = Network(**{**{f: getattr(net, f) for f in net.__dataclass_fields__}, name: values})
        means = np.array([n.pooled(x).mean(axis=0) for x in drawn], np.float64)
        p = 1 / (1 + np.exp(-n.log_odds(means)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    slope, value = byte_cnn._slopes(net, drawn, labels)[name], getattr(net, name).astype(np.float64)
    direction = slope / np.sqrt((slope * slope).sum())
    ahead = (loss(value + 1e-4 * direction) - loss(value - 1e-4 * direction)) / 2e-4
    assert math.isclose(ahead, np.sqrt((slope * slope).sum()), rel_tol=0.02)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_held_out_accuracy(spark):
    folder = data_folder("0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = byte_cnn.fit(docs, labels, per_class=500)
    got = byte_cnn.score_quality(docs.join(labels, "doc_id"), net).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert np.mean([r.predicted for r in got if r.quality]) > 0.97
    ordered = sorted(got, key=lambda r: r.score)
    ranks = [k for k, r in enumerate(ordered) if r.quality]
    low = len(got) - len(ranks)
    assert (sum(ranks) - len(ranks) * (len(ranks) - 1) / 2) / (len(ranks) * low) > 0.98


def test_odd_rows_and_clashing_names(spark):
    net = network(Shape())
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "long " * 60_000)]
    docs = frame(spark, [(*r, "x", 9.0, 1) for r in rows], "doc_id long, text string, held_out string, score double, _id int")
    got = sorted((tuple(r) for r in byte_cnn.score_quality(docs, net).collect()), key=str)
    want = sorted(
        ((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, s, int(s >= 0.3)) for (i, _), s in zip(rows, net.score([(t or "").encode() for _, t in rows]))), key=str)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None), (2, 7)]])
def test_one_class_or_none(spark, labels):
    docs = frame(spark, [(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    net = byte_cnn.fit(docs, frame(spark, labels, "doc_id long, quality int"))
    scores = {r.score for r in byte_cnn.score_quality(docs, net).collect()}
    assert len(scores) == 1
    kept = {q for i, q in labels if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    assert next(iter(scores)) == 0.5 if not kept else (next(iter(scores)) > 0.99) == (kept == {1})


def test_empty_table(spark):
    assert byte_cnn.score_quality(frame(spark, [], "doc_id long, text string"), network(Shape())).collect() == []
