import hashlib

import pytest

import corpus_pipeline
from tablewright.llm import queries as Q
from tests.oracle import connect, data_folder, difference


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    folder = data_folder("0.001")
    got = Q.QUERIES[name](spark, folder)
    want = connect(folder).execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    assert difference(got.columns, [tuple(r) for r in got.collect()], columns, want.fetchall()) is None


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_has_a_row_per_row_of_its_table(spark, name):
    folder = data_folder("0.001")
    got = Q.QUERIES[name](spark, folder)
    key = "page_id" if name == "op3_main_text" else "doc_id"
    table = "pages" if name == "op3_main_text" else "documents"
    want = {r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in got.select(key).collect()} == want


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it wrote; the exact ones are compared with plain Python."""
    from tests.llm.test_near_dups import brute as near
    from tests.llm.test_repeats import brute as repeats

    folder = data_folder("0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "benchmark_leaks", "packing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.written(stage(spark, frames[-1], folder), name))
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:5]]
    for f in frames[:5]:
        assert f.columns == list(corpus_pipeline.COLUMNS) and f.dtypes == docs.dtypes
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) > 0.8 * len(rows[0])
    assert set(rows[2]) == {i for i, _, _, kept in near([(i, r.text) for i, r in rows[1].items()], 80) if kept}
    before, after = rows[2], rows[3]
    assert set(after) == set(before)
    want = dict(zip(before, repeats([r.text for r in before.values()], 200)))
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        if r.text.isascii() and before[i].text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][3]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not [i for i, r in rows[4].items() if any(x in r.text for x in items)]
    assert {i for i in rows[3] if any(x in rows[3][i].text for x in items)} <= set(rows[3]) - set(rows[4])
    pieces = frames[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {p.doc_id for p in pieces} == set(rows[4]) and all(p["sum(length)"] == p["max(doc_tokens)"] for p in pieces)
