"""A collection of tables: which is primary, how they link, what is rolled up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .schema import kind_of, table_prefix


@dataclass(frozen=True)
class Relationship:
    left_table: str
    right_table: str
    left_column: str
    right_column: str
    join_type: str = "left"


@dataclass(frozen=True)
class Aggregation:
    table: str
    group_by: str
    prefix: str
    features: Sequence[Mapping]
    order_by: Sequence[str] | None = None


@dataclass(frozen=True)
class Collection:
    """``order_by`` names, per table, the columns that define its row order."""

    primary: str
    tables: Sequence[str]
    relationships: Sequence[Relationship] = ()
    aggregations: Sequence[Aggregation] = ()
    target: str | None = None
    order_by: Mapping[str, Sequence[str]] = field(default_factory=dict)


def target_column(tables: Mapping[str, DataFrame], primary: str, explicit: str | None = None,
                  project: str | None = None) -> str | None:
    """The target: the one named, else ``{project}__target``, else ``TARGET``."""
    columns = tables[primary].columns
    if explicit is not None:
        if explicit not in columns:
            raise ValueError(f"target column '{explicit}' not in table '{primary}'")
        return explicit
    guesses = ([f"{project}__target"] if project else []) + ["TARGET"]
    return next((g for g in guesses if g in columns), None)


def orphaned_aggregations(collection: Collection) -> list[str]:
    """Tables that are rolled up but that no relationship joins."""
    used = {r.right_table for r in collection.relationships}
    return [a.table for a in collection.aggregations if a.table not in used]


def validate_collection(collection: Collection, tables: Mapping[str, DataFrame], columns: bool = True) -> list[str]:
    """Everything wrong with the configuration, judged by schemas alone.

    ``columns=False`` leaves out missing columns, which a build skips with a warning.
    """
    problems = []
    if collection.primary not in tables:
        problems.append(f"primary table '{collection.primary}' is unknown")
    pairs = set()
    for r in collection.relationships:
        for table, column in ((r.left_table, r.left_column), (r.right_table, r.right_column)):
            if table not in tables:
                problems.append(f"table '{table}' is unknown")
            elif columns and column not in tables[table].columns:
                problems.append(f"column '{column}' not in table '{table}'")
        if r.left_table == r.right_table:
            problems.append(f"table '{r.left_table}' cannot be joined to itself")
        pair = (r.left_table, r.right_table, r.left_column, r.right_column)
        if pair in pairs:
            problems.append(f"relationship {pair} is given twice")
        pairs.add(pair)
    seen = set()
    for a in collection.aggregations:
        if a.table in seen:
            problems.append(f"table '{a.table}' has more than one aggregation")
        seen.add(a.table)
        if a.table not in tables:
            problems.append(f"table '{a.table}' is unknown")
            continue
        for column in [a.group_by, *[f["column"] for f in a.features]]:
            if columns and column not in tables[a.table].columns:
                problems.append(f"column '{column}' not in table '{a.table}'")
    target = collection.target
    if columns and target and collection.primary in tables and target not in tables[collection.primary].columns:
        problems.append(f"target column '{target}' not in table '{collection.primary}'")
    return problems


def join_columns(relationships: Iterable[Relationship]) -> dict[str, str]:
    """Table -> the column it is joined on, by its first relationship."""
    out: dict[str, str] = {}
    for r in relationships:
        out.setdefault(r.left_table, r.left_column)
        out.setdefault(r.right_table, r.right_column)
    return out


# Names that mark a key, and the functions by kind of column.
_KEY_MARKS = ("_id", "sk_id", "index")
_FUNCTIONS = {"numeric": ["sum", "mean", "max"], "categorical": ["nunique"]}


def _useful(row: Mapping | None) -> bool:
    """A column worth aggregating: profiled, no key, some value, more than one of them."""
    return (
        row is not None and not row["is_potential_key"] and not any(mark in row["name"].lower() for mark in _KEY_MARKS)
        and (row["null_percentage"] or 0) < 100 and (row["unique_count"] or 0) > 1
    )


def auto_aggregations(tables: Mapping[str, DataFrame], profiles: Mapping[str, Sequence[Mapping]],
                      primary: str, keys: Mapping[str, str], most: Mapping[str, int] | None = None,
                      warnings: list[str] | None = None) -> list[Aggregation]:
    """An aggregation per related table, chosen from its column profile.

    ``profiles`` holds per table the profile rows (``name``, ``null_percentage``,
    ``unique_count``, ``is_potential_key``): one small row per column.  A table
    without a join column falls back on its first potential key.  ``most``
    bounds the columns a table may add by kind (``{"numeric": 10}``); what that
    leaves out is told in ``warnings``.
    """
    out = []
    for table in (t for t in tables if t != primary):
        rows = {r["name"]: r for r in profiles.get(table, [])}
        potential = [n for n, r in rows.items() if r["is_potential_key"]]
        key = keys.get(table) or (potential[0] if potential else None)
        fields = [f for f in tables[table].schema.fields if _useful(rows.get(f.name))]
        by_kind = {kind: [f.name for f in fields if kind_of(f.dataType) == kind] for kind in _FUNCTIONS}
        chosen = {kind: names[: (most or {}).get(kind)] for kind, names in by_kind.items()}
        if warnings is not None:
            warnings += [f"{table}.{n}: left out" for kind in by_kind for n in by_kind[kind][len(chosen[kind]):]]
        features = [
            {"column": f.name, "functions": _FUNCTIONS[kind]} for f in fields for kind, names in chosen.items() if f.name in names
        ]
        if key and features:
            out.append(Aggregation(table, key, table_prefix(table), features))
    return out
