"""Registration and the fixture expressions both engines share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, digits: int = 4) -> Callable[[Build], Build]:
    """Register a query; its result is brought to plain types and rounded."""
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, lambda spark, sf: tidy(build(spark, sf), digits), sql)
        return build
    return register


# Averages of short decimals often end exactly halfway; engines then round either
# way.  Both sides move up by this part of the last digit first.
_NUDGE = 3e-4


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Integers as bigint, floats rounded, timestamps and string arrays as text."""
    out = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            value = value.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            value = value.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            value = F.round(value.cast("double") + _NUDGE * 10.0 ** -digits, digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            value = F.array_join(value, "|")
        out.append(value.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(expression: str, digits: int = 4) -> str:
    """SQL: rounded as ``tidy`` does, and never a negative zero."""
    return f"(round({expression} + {_NUDGE * 10.0 ** -digits!r}::DOUBLE, {digits}) + 0.0)"


def own(expression: str, digits: int) -> str:
    """SQL: for a value the operator itself rounds."""
    return f"(round({expression}, {digits}) + 0.0)"


def ts(expression: str) -> str:
    """SQL: a timestamp as text."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


# Orders with missing values and keys: the test tables hold none.
HOLES = (
    "o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, "
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, "
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority"
)


def orders_with_holes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_split(HOLES))


def orders_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth order twice."""
    orders = table(spark, sf, "orders")
    return orders.union(orders.filter("o_orderkey % 10 = 0"))


ORDERS_WITH_COPIES = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"
ORDERS_WITH_HOLES = f"(SELECT {HOLES} FROM orders)"

# Line items with columns that are correlated, and a constant one.
NUMBERS = (
    "l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, "
    "-2 * l_quantity + l_tax AS mirrored, CAST(1.0 AS DOUBLE) AS k"
)
NUMBER_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "mirrored", "k"]


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*_split(NUMBERS))


# Label and score over all orders; under 2000 distinct scores, so ties abound.
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label",
        "CAST(0.7D * ((o_orderkey * 7919) % 1000) / 1000.0D + CASE WHEN o_totalprice > 250000 THEN 0.3D ELSE 0.0D END AS DOUBLE) AS score")


SCORED_SQL = (
    "(SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label, "
    "0.7::DOUBLE * ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE "
    "+ CASE WHEN o_totalprice > 250000 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders)"
)

# Events as a prediction log.
LOG = (
    "event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN user_id % 3 = 0 THEN 'forest' ELSE 'logistic' END AS model, "
    "CASE WHEN event_type = 'purchase' THEN 'batch' ELSE 'single' END AS type, "
    "CASE WHEN value >= 50 THEN '>50K' ELSE '<=50K' END AS prediction, "
    "least(value / 100.0, 1.0) AS probability, CAST(event_id % 97 AS DOUBLE) AS latency_ms, "
    "event_type = 'error' AS failed"
)


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*_split(LOG))


LOG_SQL = f"(SELECT {LOG} FROM events)"

# Events as training-log lines of one job per ten users.
ALGORITHMS = ["LogisticRegression", "RandomForestClassifier", "KMeans", "LinearSVC", "ensemble"]
_NAME = "CASE " + " ".join(f"WHEN user_id % 5 = {i} THEN '{a}'" for i, a in enumerate(ALGORITHMS)) + " END"
LINES = (
    "CAST(user_id % 10 AS VARCHAR(10)) AS job, event_id AS position, "
    f"CASE WHEN event_type = 'signup' THEN concat('Training ', {_NAME}, '...') "
    f"WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN concat('✅ ', {_NAME}, ': Train=0.8037') "
    f"WHEN event_type = 'error' THEN concat('❌ ', {_NAME}, ' failed') ELSE 'noise' END AS line"
)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*_split(LINES)).withColumn("job", F.col("job").cast("string"))


LINES_SQL = f"(SELECT {LINES} FROM events)"

# Parts as an algorithm report: one row per brand and type.
REPORT = (
    "concat(p_brand, ' (', p_type, ')') AS \"Algorithm\", avg(p_retailprice) / 2000.0 AS \"Train_Score\", "
    "avg(p_size) / 50.0 AS \"Test_Score\""
)


def report(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        (F.avg("p_retailprice") / 2000.0).alias("Train_Score"), (F.avg("p_size") / 50.0).alias("Test_Score"),
    ).select(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")).alias("Algorithm"), "Train_Score", "Test_Score")


REPORT_SQL = f"(SELECT {REPORT} FROM part GROUP BY p_brand, p_type)"


def _split(select_list: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(select_list):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            parts.append(select_list[start:i].strip())
            start = i + 1
    parts.append(select_list[start:].strip())
    return parts
