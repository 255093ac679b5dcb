"""Find, check and review the keys that link the tables of a collection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.text import plain_name
from ..plans.collection import Collection
from ..plans.schema import cell_key, is_numeric
from .aggregate import created_columns


def _judged(stats: DataFrame) -> DataFrame:
    """Add the share of keys that match and the cardinality to counts of keys and rows."""
    base = F.least("left_unique_count", "right_unique_count")
    left_one = F.col("left_unique_count") == F.col("left_rows")
    right_one = F.col("right_unique_count") == F.col("right_rows")
    pct = F.round(F.col("match_count") / F.when(base > 0, base).otherwise(1) * 100, 2)
    kind = (
        F.when(left_one & right_one, "one_to_one").when(left_one, "one_to_many")
        .when(right_one, "many_to_one").otherwise("many_to_many")
    )
    return stats.withColumn("match_percentage", pct).withColumn("relationship_type", kind)


def validate_relationship(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row on how well two key columns match.

    Both sides are reduced to (key, rows) before they meet, so a hot key is one
    row in the join.  Cardinality counts null keys as rows, so a key with nulls
    is not unique.  A number never equals a text here.
    """
    lt, rt = left.schema[left_key].dataType, right.schema[right_key].dataType
    a, b = col(left_key), col(right_key)
    if is_numeric(lt) != is_numeric(rt):
        a = F.when(a.isNotNull(), F.concat(F.lit("number " if is_numeric(lt) else "text "), a.cast("string")))
        b = F.when(b.isNotNull(), F.concat(F.lit("number " if is_numeric(rt) else "text "), b.cast("string")))
    ls = left.groupBy(a.alias("lk")).agg(F.count(F.lit(1)).alias("ln"))
    rs = right.groupBy(b.alias("rk")).agg(F.count(F.lit(1)).alias("rn"))
    has_l, has_r = F.col("lk").isNotNull(), F.col("rk").isNotNull()
    stats = ls.join(rs, F.col("lk") == F.col("rk"), "full").agg(
        F.count_if(has_l).alias("left_unique_count"),
        F.count_if(has_r).alias("right_unique_count"),
        F.count_if(has_l & has_r).alias("match_count"),
        F.count_if(has_l & ~has_r).alias("orphan_left_count"),
        F.count_if(~has_l & has_r).alias("orphan_right_count"),
        F.coalesce(F.sum("ln"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("rn"), F.lit(0)).alias("right_rows"),
    )
    out = _judged(stats)
    out = out.withColumn("left_column_dtype", F.lit(lt.simpleString()))
    out = out.withColumn("right_column_dtype", F.lit(rt.simpleString()))
    texts = [
        F.when(F.col("match_percentage") < 50, F.concat(
            F.lit("Low key match rate ("), F.col("match_percentage").cast("string"),
            F.lit("%), possibly wrong join columns"))),
        F.when(F.col("orphan_left_count") > 0, F.concat(
            F.col("orphan_left_count").cast("string"), F.lit(" keys in left table have no match in right table"))),
        F.when(F.col("orphan_right_count") > 0, F.concat(
            F.col("orphan_right_count").cast("string"), F.lit(" keys in right table have no match in left table"))),
        F.when(F.lit(lt != rt), F.lit(f"Data type mismatch: {lt.simpleString()} vs {rt.simpleString()}")),
    ]
    return out.withColumn("warnings", F.array_compact(F.array(*texts)))


# Names too common to prove a relationship.
_COMMON_NAMES = ["id", "index", "name", "type", "status", "date"]


def _inner_pieces(name: Column) -> Column:
    """Every distinct substring of a column name (names are short)."""
    at = F.sequence(F.lit(1), F.length(name))
    pieces = F.transform(at, lambda i: F.transform(
        F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)))
    return F.array_distinct(F.flatten(pieces))


def suggest_relationships(profiles: DataFrame) -> DataFrame:
    """Best join-key guess per (primary, related) table pair, from column profiles.

    ``profiles`` has one row per column: table_name, role, name,
    is_potential_key.  Equal names score 0.9, 0.95 when the primary's column is
    a potential key and 0.5 for common names; a primary ``_id``/key column with
    a similar ``_id`` column scores 0.6.  Ties go to the first name.
    "Similar" is one name inside the other.  Names and their substrings become
    tokens and meet in one equi-join, so there is no product of the columns.
    """
    cols = profiles.filter(F.length("name") > 0).select(
        "table_name", "role", "name", F.coalesce("is_potential_key", F.lit(False)).alias("is_key"),
        plain_name(F.col("name")).alias("plain"), F.lower("name").endswith("_id").alias("id_like"),
    )
    one = F.array(F.struct(F.lit("same").alias("kind"), F.col("name").alias("token")))
    plain = F.array(F.struct(F.lit("right inside left").alias("kind"), F.col("plain").alias("token")))

    def pieces(kind: str) -> Column:
        return F.transform(_inner_pieces(F.col("plain")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    none = F.array().cast("array<struct<kind:string,token:string>>")
    inside_left, inside_right = "right inside left", "left inside right"
    linkable = F.col("id_like") | F.col("is_key")
    whole = F.transform(plain, lambda t: F.struct(F.lit(inside_right).alias("kind"), t["token"].alias("token")))
    p = cols.filter("role = 'primary'").select(
        F.col("table_name").alias("left_table"), F.col("name").alias("left_column"), "is_key",
        F.inline(F.concat(one, F.when(linkable, F.concat(pieces(inside_left), whole)).otherwise(none))))
    r = cols.filter("role <> 'primary'").select(
        F.col("table_name").alias("right_table"), F.col("name").alias("right_column"),
        F.inline(F.concat(one, F.when(F.col("id_like"), F.concat(plain, pieces(inside_right))).otherwise(none))))

    met = p.join(r, ["kind", "token"])
    same = F.col("left_column") == F.col("right_column")
    common = F.lower("left_column").isin(_COMMON_NAMES)
    quote = F.concat(F.lit("'"), F.col("left_column"), F.lit("'"))
    scored = met.filter((F.col("kind") == "same") | ~same).select(
        "left_table", "right_table", "left_column", "right_column",
        F.when(~same, F.lit(0.6)).when(common, F.lit(0.5)).when(F.col("is_key"), F.lit(0.95))
        .otherwise(F.lit(0.9)).alias("confidence"),
        F.when(~same, F.concat(F.lit("ID pattern match: "), quote, F.lit(" ↔ '"), F.col("right_column"), F.lit("'")))
        .when(common, F.concat(F.lit("Common column name match: "), quote, F.lit(" (may be coincidental)")))
        .when(F.col("is_key"), F.concat(F.lit("Primary key match: "), quote))
        .otherwise(F.concat(F.lit("Exact column name match: "), quote)).alias("reason"),
    )
    best = Window.partitionBy("left_table", "right_table").orderBy(
        F.col("confidence").desc(), "left_column", "right_column")
    return scored.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def _link_key(field: T.StructField) -> Column:
    """A value as (kind, a, b), alike for values that are equal as keys: a whole number of any type, a text, or one type's own."""
    value, kind = col(field.name), field.dataType
    if is_numeric(kind):
        whole = value.try_cast("bigint")
        is_whole = F.coalesce(whole.cast(kind) == value, F.lit(False))
        a = F.when(is_whole, F.xxhash64(whole)).otherwise(F.xxhash64(value.cast("double")))
        return F.struct(F.lit("number").alias("kind"), F.when(value.isNotNull(), a).alias("a"), F.when(is_whole, 0).otherwise(1).cast("bigint").alias("b"))
    a, b = cell_key(field)
    return F.struct(F.lit(kind.simpleString()).alias("kind"), a.alias("a"), b.alias("b"))


_PAIR = ["left_table", "right_table", "left_column", "right_column", "confidence"]


def measure_suggestions(suggestions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Suggestions with the match statistics of their data, as ``validate_relationship`` has them for one.

    One plan for any number of suggestions: each table gives its cells as (table,
    column, key), those of suggested columns are named by their suggestions (one
    row per pair of tables, so broadcast), and one aggregate by (suggestion, key)
    tells which sides hold a key and how often.  A hot key is one row per task
    there.  A suggestion of a table that isn't given has no row.
    """
    cells = None
    for name, df in tables.items():
        parts = [F.struct(F.lit(c).alias("_column"), _link_key(df.schema[c]).alias("_key")) for c in df.columns]
        some = df.select(F.lit(name).alias("_table"), F.inline(F.array(*parts)))
        cells = some if cells is None else cells.unionByName(some)
    if cells is None:
        return suggestions.sparkSession.createDataFrame([], (
            "left_table string, right_table string, left_column string, right_column string, confidence double, "
            "relationship_type string, match_count bigint, match_percentage double, orphan_left_count bigint, orphan_right_count bigint"
        ))
    pair = F.struct(*_PAIR).alias("_pair")
    sides = suggestions.select(pair, F.inline(F.array(*[
        F.struct(F.col(f"{side}_table").alias("_t"), F.col(f"{side}_column").alias("_c"), F.lit(side).alias("_side")) for side in ("left", "right")])))
    named = cells.join(F.broadcast(sides), (F.col("_table") == F.col("_t")) & (F.col("_column") == F.col("_c")))
    keys = named.groupBy("_pair", F.col("_key.kind").alias("_kind"), F.col("_key.a").alias("_a"), F.when(F.col("_key.a").isNotNull(), F.col("_key.b")).alias("_b")).agg(
        F.count_if(F.col("_side") == "left").alias("_ln"), F.count_if(F.col("_side") == "right").alias("_rn"))
    key, has_l, has_r = F.col("_a").isNotNull(), F.col("_ln") > 0, F.col("_rn") > 0
    stats = keys.groupBy("_pair").agg(
        F.count_if(key & has_l).alias("left_unique_count"), F.count_if(key & has_r).alias("right_unique_count"),
        F.count_if(key & has_l & has_r).alias("match_count"), F.count_if(key & has_l & ~has_r).alias("orphan_left_count"),
        F.count_if(key & ~has_l & has_r).alias("orphan_right_count"), F.sum("_ln").alias("left_rows"), F.sum("_rn").alias("right_rows"))
    return _judged(stats).select(
        "_pair.*", "relationship_type", "match_count", "match_percentage", "orphan_left_count", "orphan_right_count")


def collection_review(collection: Collection, tables: Mapping[str, DataFrame],
                      matches: Mapping[str, float] | None = None) -> DataFrame:
    """Dry run, one row: input totals, expected width, warnings, readiness.

    ``matches`` maps a related table to its measured match percentage.  Row
    counts are the only pass over data.
    """
    warnings = []
    if collection.primary not in tables:
        warnings.append("No primary table selected")
    if len(tables) < 2:
        warnings.append("Need at least 2 tables for multi-table processing")
    if not collection.relationships:
        warnings.append("No relationships defined, tables won't be joined")
    rolled = {a.table for a in collection.aggregations}
    joined = {r.right_table for r in collection.relationships}
    for table in tables:
        if table != collection.primary and table in joined and table not in rolled:
            warnings.append(f"Table '{table}' has a relationship but no aggregation configured")
    for r in collection.relationships:
        pct = (matches or {}).get(r.right_table)
        if pct is not None and pct < 50:
            warnings.append(f"Low join match ({pct}%) between '{r.left_table}' and '{r.right_table}'")
    counts = None
    for df in tables.values():
        one = df.agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.union(one)
    made = sum(len(created_columns(a.prefix, a.features)) for a in collection.aggregations)
    width = len(tables[collection.primary].columns) if collection.primary in tables else 0
    ready = collection.primary in tables and len(tables) >= 2 and bool(collection.relationships)
    return counts.agg(F.sum("n").alias("total_input_rows")).select(
        "total_input_rows",
        F.lit(sum(len(df.columns) for df in tables.values())).alias("total_input_columns"),
        F.lit(width + made).alias("estimated_output_columns"),
        F.lit(len(tables)).alias("total_tables"),
        F.lit(len(collection.relationships)).alias("total_relationships"),
        F.lit(len(collection.aggregations)).alias("total_aggregations"),
        F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
        F.lit(ready).alias("ready_to_process"),
    )


def collection_listing(collections: DataFrame, tables: DataFrame, relationships: DataFrame,
                       aggregations: DataFrame) -> DataFrame:
    """Collections with their numbers of tables, relationships and aggregations.

    Each detail is counted per collection before it is joined.
    """
    out = collections
    for name, detail in (("total_tables", tables), ("total_relationships", relationships),
                         ("total_aggregations", aggregations)):
        counted = detail.groupBy(F.col("collection_id").alias("_id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, F.col("id") == F.col("_id"), "left").drop("_id")
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two column profiles of one dataset side by side: what changed between versions."""
    a = old.select(F.col("name").alias("_old"), F.col("dtype").alias("old_dtype"),
                   F.col("null_percentage").alias("old_null_percentage"), F.col("unique_count").alias("old_unique"))
    b = new.select(F.col("name").alias("_new"), F.col("dtype").alias("new_dtype"),
                   F.col("null_percentage").alias("new_null_percentage"), F.col("unique_count").alias("new_unique"))
    same = (
        (F.col("old_dtype") == F.col("new_dtype")) & (F.col("old_unique") == F.col("new_unique"))
        & F.col("old_null_percentage").eqNullSafe(F.col("new_null_percentage"))
    )
    return a.join(b, F.col("_old") == F.col("_new"), "full").select(
        F.coalesce("_old", "_new").alias("name"),
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(same, "unchanged").otherwise("changed").alias("change"),
        "old_dtype", "new_dtype",
        (F.col("new_null_percentage") - F.col("old_null_percentage")).alias("null_percentage_change"),
        (F.col("new_unique") - F.col("old_unique")).alias("unique_change"),
    )

