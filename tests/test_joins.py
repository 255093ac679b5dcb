import pytest
from pyspark.sql import functions as F

from tablewright.operators.aggregate import aggregate_table
from tablewright.operators.derive import build_report, build_wide_table, guard_report, warning_rows
from tablewright.operators.joins import first_row_per_key, join_tables, matched_rows, orphan_rows
from tablewright.operators.relationships import collection_review, measure_suggestions, suggest_relationships, validate_relationship
from tablewright.plans.collection import Aggregation, Collection, Relationship, target_column, validate_collection


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")


@pytest.fixture
def visits(spark):
    return spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (None, 12, "z"), (None, 13, "w"), (9, 14, "v")],
                                 "person int, visit int, name string")


def test_null_keys_meet(people, visits):
    out = join_tables(people, first_row_per_key(visits, "person", ["visit"]), "id", "person", "left", "visits").df
    assert {(r.id, r.name, r.visit, r.visits_name) for r in out.collect()} == {
        (1, "a", 10, "x"), (2, "b", None, None), (None, "c", 12, "z")}


@pytest.mark.parametrize("how,rows", [("left", 5), ("inner", 4), ("right", 5), ("full", 6)])
def test_join_types_against_pandas(people, visits, how, rows):
    out = join_tables(people, visits, "id", "person", how, "visits").df
    expected = people.toPandas().merge(
        visits.toPandas().rename(columns={"name": "visits_name"}), left_on="id", right_on="person",
        how={"full": "outer"}.get(how, how))
    assert out.count() == len(expected) == rows
    if how in ("right", "full"):
        assert out.filter("id = 9").first().visits_name == "v"  # the key of a right-only row survives


def test_key_coercion(spark):
    ints = spark.createDataFrame([(1,), (2,)], "k bigint")
    for other, cast in (("double", "double"), ("string", "string")):
        right = spark.createDataFrame([(1, "hit")], "j int, tag string").withColumn("j", F.col("j").cast(cast))
        assert join_tables(ints, right, "k", "j", "inner").df.count() == 1
    floats = spark.createDataFrame([(1.0,), (2.5,)], "k double")
    texts = spark.createDataFrame([("1", "a"), ("2.5", "b")], "j string, tag string")
    assert join_tables(floats, texts, "k", "j", "inner").df.count() == 2


def test_right_key_name_also_on_the_left(spark):
    left = spark.createDataFrame([(1, 100)], "a int, b int")
    right = spark.createDataFrame([(1, 7)], "b int, v int")
    row = join_tables(left, right, "a", "b", "left", "r").df.first()
    assert (row.a, row.b, row.v) == (1, 100, 7)


def test_dotted_names(spark):
    left = spark.createDataFrame([(1, 2)], "a int, x int").withColumnRenamed("a", "k.1")
    right = spark.createDataFrame([(1, 3)], "b int, y int").withColumnRenamed("b", "k.2")
    assert join_tables(left, right, "k.1", "k.2").df.columns == ["k.1", "x", "y"]


def test_orphans_and_matches(people, visits):
    assert {r.visit for r in orphan_rows(visits, people, "person", "id").collect()} == {12, 13, 14}
    assert {r.visit for r in matched_rows(visits, people, "person", "id").collect()} == {10, 11}


def test_guard_keeps_left_rows_and_reports(spark, people, visits):
    tables = {"people": people, "visits": visits}
    c = Collection("people", ["people", "visits"], [Relationship("people", "visits", "id", "person")],
                   order_by={"visits": ["visit"]})
    built = build_wide_table(c, tables)
    assert built.df.count() == people.count()
    report = guard_report(built).first()
    assert (report.total_rows, report.unique_keys, report.explodes) == (5, 2, True)
    assert build_wide_table(c, tables, guard=False).df.count() == 5
    row = build_report(built).first()
    assert (row.rows_before, row.rows_after, row.columns_added, row.tables_joined) == (3, 3, 2, 1)


def test_chain_join_and_orphaned_aggregation(spark, people, visits):
    city = spark.createDataFrame([("x", "rome")], "tag string, city string")
    c = Collection(
        "people", ["people", "visits", "city"],
        [Relationship("people", "visits", "id", "person"), Relationship("visits", "city", "visits_name", "tag")],
        [Aggregation("city", "tag", "C_", [{"column": "city", "functions": ["count"]}])],
        order_by={"visits": ["visit"]})
    # the second left column exists only under its new name, so validation by schema names it
    assert validate_collection(c, {"people": people, "visits": visits, "city": city})
    c2 = Collection("people", ["people", "visits"], [Relationship("people", "visits", "id", "person")],
                    [Aggregation("people", "id", "P_", [{"column": "name", "functions": ["count"]}])],
                    order_by={"visits": ["visit"]})
    built = build_wide_table(c2, {"people": people, "visits": visits})
    assert any("no relationship" in r.warning for r in warning_rows(built).collect())


def test_missing_and_duplicates_options(spark):
    p = spark.createDataFrame([(1, None), (1, None), (2, 5.0)], "id int, v double")
    c = Collection("p", ["p"], order_by={"p": ["id"]})
    assert build_wide_table(c, {"p": p}, drop_duplicates=True).df.count() == 2
    assert build_wide_table(c, {"p": p}, handle_missing="drop_rows").df.count() == 1
    assert build_wide_table(c, {"p": p}, handle_missing="fill_zero").df.filter("v = 0").count() == 2
    with pytest.raises(ValueError):
        build_wide_table(c, {"p": p}, handle_missing="guess")


def test_validation_of_configuration(spark, people, visits):
    tables = {"people": people, "visits": visits}
    bad = Collection("people", ["people"], [Relationship("people", "people", "id", "id"),
                                            Relationship("people", "gone", "id", "x"),
                                            Relationship("people", "visits", "id", "nope")],
                     [Aggregation("visits", "person", "", []), Aggregation("visits", "person", "", [])], target="t")
    assert len(validate_collection(bad, tables)) == 5
    assert target_column({"p": spark.createDataFrame([], "TARGET int, a int")}, "p") == "TARGET"
    assert target_column({"p": spark.createDataFrame([], "x__target int")}, "p", project="x") == "x__target"
    with pytest.raises(ValueError):
        target_column(tables, "people", "gone")


def test_relationship_kinds(spark, people, visits):
    row = validate_relationship(people, visits, "id", "person").first()
    # a key with a null is not unique: nulls count as rows
    assert (row.relationship_type, row.match_count, row.orphan_left_count, row.orphan_right_count) == ("many_to_many", 1, 1, 1)
    assert row.match_percentage == 50.0 and row.match_count + row.orphan_left_count == row.left_unique_count
    one = spark.createDataFrame([(1,), (2,)], "k bigint")
    text = spark.createDataFrame([("1",)], "k string")
    stats = validate_relationship(one, text, "k", "k").first()
    assert stats.match_count == 0 and any("mismatch" in w for w in stats.warnings)
    assert validate_relationship(one, one.limit(0), "k", "k").first().match_percentage == 0.0


def test_suggestions(spark):
    rows = [("p", "primary", "SK_ID", True), ("p", "primary", "name", False), ("p", "primary", "client_id", False),
            ("r1", "related", "SK_ID", False), ("r1", "related", "name", False), ("r2", "related", "name", False),
            ("r3", "related", "the_client_id", False), ("r4", "related", "zzz", False)]
    out = suggest_relationships(spark.createDataFrame(rows, "table_name string, role string, name string, is_potential_key boolean"))
    got = {r.right_table: (r.left_column, r.right_column, r.confidence) for r in out.collect()}
    assert got == {"r1": ("SK_ID", "SK_ID", 0.95), "r2": ("name", "name", 0.5), "r3": ("client_id", "the_client_id", 0.6)}


def test_review(spark, people):
    row = collection_review(Collection("people", ["people"]), {"people": people}).first()
    assert not row.ready_to_process and len(row.warnings) == 2 and row.total_input_rows == 3


def test_first_row_is_that_of_the_files_under_any_partitioning(spark, tmp_path):
    """Values fall in the order of the files, so neither key nor value could lead to the right row by chance."""
    path = str(tmp_path / "rows")
    rows = spark.range(5000).select((F.col("id") % 37).alias("k"), (5000 - F.col("id")).alias("v"), F.col("id"))
    for part in range(4):
        rows.filter(f"id div 1250 = {part}").coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 4096).mode("append").parquet(f"{path}/part={part}")
    want = {k: k for k in range(37)}
    for n in (1, 7, 64):
        df = spark.read.parquet(path).repartition(n).filter("v > 0").withColumn("more", F.lit(1))
        assert {r.k: r.id for r in first_row_per_key(df, "k").collect()} == want
        out, _ = aggregate_table(df, "k", "", [{"column": "id", "functions": ["first", "last"]}])
        assert {r.k: (r.id_first, r.id_last) for r in out.collect()} == {k: (k, max(range(k, 5000, 37))) for k in range(37)}
    csv = str(tmp_path / "csv")
    rows.coalesce(1).sortWithinPartitions("id").write.option("header", True).csv(csv)
    read = spark.read.option("header", True).csv(csv)
    assert {int(r.k): int(r.id) for r in first_row_per_key(read, "k").collect()} == want
    assert len(first_row_per_key(rows, "k").collect()) == 37  # no files at all


def test_all_suggestions_are_measured_in_one_plan(spark):
    """The same numbers as pair by pair, over keys of unlike types, nulls and repeats, without a branch per suggestion."""
    tables = {
        "a": spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.5), (2, None, None), (None, "z", 2.0**60)], "id int, t string, d double"),
        "b": spark.createDataFrame([(1.0, "x"), (3.5, "y"), (2.0, "y"), (None, None)], "id double, t string"),
        "c": spark.createDataFrame([(1, 1), (2, 2**60), (7, None)], "id int, n bigint").withColumn("id", F.col("id").cast("decimal(10,0)")),
        "e": spark.createDataFrame([("1",), ("x" * 400,)], "id string"),
    }
    pairs = [("a", "b", "id", "id"), ("a", "b", "t", "t"), ("a", "c", "id", "id"), ("a", "c", "d", "n"), ("b", "c", "id", "id"), ("a", "e", "id", "id"), ("a", "e", "t", "id")]
    suggested = spark.createDataFrame([(*p, 0.9) for p in pairs], "left_table string, right_table string, left_column string, right_column string, confidence double")
    out = measure_suggestions(suggested, tables)
    got = {tuple(r)[:4]: tuple(r)[5:] for r in out.collect()}
    for left, right, x, y in pairs:
        one = validate_relationship(tables[left], tables[right], x, y).first()
        assert got[left, right, x, y] == (one.relationship_type, one.match_count, one.match_percentage, one.orphan_left_count, one.orphan_right_count)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FullOuter") == 0 and "CartesianProduct" not in plan
    assert measure_suggestions(suggested.limit(0), tables).collect() == []
