"""Correlation and collinearity.

Everything is derived from one frame of column pairs (k columns give k(k-1)/2
rows), so compute it once with ``pair_correlations`` and pass it on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, name_frame, share
from ..functions.numbers import matrix_strength, pair_strength, vif_severity
from ..functions.tails import correlation_p_value
from ..plans.schema import numeric_columns

# Columns up to which all pairs fit one aggregate the JVM still compiles well (each pair
# needs a covariance, pairwise deletion two deviations more); beyond, the pairs come
# from matrix partials.
_ONE_AGGREGATE = {True: 5, False: 4}  # listwise, pairwise


def pair_correlations(df: DataFrame, columns: Sequence[str] | None = None, listwise: bool = False) -> DataFrame:
    """Pearson r of every column pair: i, j, column1, column2, correlation, n.

    ``i < j`` are positions in the column list.  ``listwise`` keeps only rows
    without any missing value; otherwise each pair uses the rows where both are
    present.  NaN is missing.  r is null when a column is constant: when the
    deviation of its centred values is under a millionth of the largest of them.
    Fewer than two columns have no pairs.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, column1 string, column2 string, correlation double, n bigint")
    value = [col(c).cast("double") for c in names]
    rows = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(value)])
    if listwise:
        rows = rows.na.drop("any")
    rows = _centred(rows)
    if len(names) <= _ONE_AGGREGATE[listwise]:
        return _pairs_by_aggregate(rows, names, listwise)
    return _pairs_by_matrix(rows, names)


_NOISE = 1e-6  # a smaller share of the largest value is rounding, not spread


def _centred(rows: DataFrame) -> DataFrame:
    """Values minus their column's mean (or its only value): a scalar subquery, so still one lazy plan.

    Both ways to the pairs start from here, so the number of columns doesn't
    change what counts as constant.
    """
    centre = rows.agg(F.struct(*[
        F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c) for c in rows.columns
    ]).alias("m")).scalar()
    return rows.withColumn("_m", centre).select(*[(F.col(c) - F.col(f"_m.{c}")).alias(c) for c in rows.columns])


def _spread(x: Column) -> Column:
    """Deviation of centred values; null where it is rounding noise."""
    size = F.greatest(F.abs(F.min(x)), F.abs(F.max(x)))
    deviation = F.stddev_samp(x)
    return F.when(deviation > size * _NOISE, deviation)


def _pairs_by_aggregate(rows: DataFrame, names: list[str], complete: bool) -> DataFrame:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    aggs = [F.count(F.lit(1)).alias("n")]
    if complete:
        aggs += [_spread(F.col(f"v{i}")).alias(f"s{i}") for i in range(len(names))]
        aggs += [F.covar_samp(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]
    else:
        both = {(i, j): F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull() for i, j in pairs}
        aggs += [F.try_divide(
            F.covar_samp(f"v{i}", f"v{j}"),
            _spread(F.when(both[i, j], F.col(f"v{i}"))) * _spread(F.when(both[i, j], F.col(f"v{j}"))),
        ).alias(f"r{i}_{j}") for i, j in pairs]
        aggs += [F.count_if(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()).alias(f"n{i}_{j}")
                 for i, j in pairs]

    def r_of(i: int, j: int):
        if complete:
            return F.try_divide(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}"))
        return F.col(f"r{i}_{j}")

    return rows.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("column1"),
                 F.lit(names[j]).alias("column2"), r_of(i, j).alias("correlation"),
                 F.col("n" if complete else f"n{i}_{j}").alias("n"))
        for i, j in pairs
    ])))


def _pairs_by_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """Sums of products per task by matrix multiplication, then added up per pair.

    Values are centred, which keeps the sums of squares small.  A mask stands
    for missing values.  Each task sends k*k rows; they are added up by pair
    and a part of the tasks first, so no pair's rows meet in one task at once.
    """
    k = len(names)
    left, right = np.triu_indices(k, 1)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
            mask = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            square = x * x
            total[0] += mask.T @ mask
            total[1] += x.T @ mask
            total[2] += square.T @ mask
            total[3] += mask.T @ square
            total[4] += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype("int32")), pa.array(right.astype("int32"))]
            + [pa.array(a[left, right]) for a in (total[0], total[1], total[1].T, total[2], total[3], total[4])],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    columns = ("n", "sx", "sy", "sxx", "syy", "sxy")
    partial = rows.mapInArrow(
        partials, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double",
    )
    part = partial.withColumn("_part", F.spark_partition_id() % 256)
    sums = part.groupBy("i", "j", "_part").agg(*[F.sum(c).alias(c) for c in columns])
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in columns])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")

    def spread(squares: Column, total: Column) -> Column:
        left_over = n * squares - total * total
        return F.when(left_over > n * squares * _NOISE**2, F.sqrt(left_over))

    r = F.try_divide(n * F.col("sxy") - sx * sy, spread(F.col("sxx"), sx) * spread(F.col("syy"), sy))
    labels = F.array(*[F.lit(x) for x in names])
    return sums.select(
        "i", "j", F.get(labels, F.col("i")).alias("column1"), F.get(labels, F.col("j")).alias("column2"),
        r.alias("correlation"), n.cast("bigint").alias("n"),
    )


def high_pairs(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs with |r| above the threshold, named in alphabetical order, 3 digits."""
    pairs = pair_correlations(df)
    return pairs.filter(F.abs("correlation") > threshold).select(
        F.least("column1", "column2").alias("column1"), F.greatest("column1", "column2").alias("column2"),
        F.round("correlation", 3).alias("correlation"),
    )


def with_p_value(pairs: DataFrame) -> DataFrame:
    """Add p_value and significant (p < 0.05); runs on k*k rows."""
    return pairs.withColumn("p_value", correlation_p_value("correlation", "n")).withColumn(
        "significant", F.coalesce((F.col("p_value") < 0.05).cast("int"), F.lit(0)))


def enhanced_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All pairs with r, p, significance and strength."""
    pairs = with_p_value(pair_correlations(df, columns))
    return pairs.select("i", "j", "column1", "column2", "correlation", "n", "p_value", "significant",
                        pair_strength(F.col("correlation")).alias("strength"))


def significant_pairs(enhanced: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs at or above the threshold that are significant."""
    return enhanced.filter((F.abs("correlation") >= threshold) & (F.col("significant") == 1))


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Matrix cells: x, y, correlation, abs_correlation, strength; diagonal included."""
    spark = pairs.sparkSession
    diagonal = name_frame(spark, [{"x": c, "y": c, "correlation": 1.0} for c in columns])
    cells = pairs.select(F.col("column2").alias("x"), F.col("column1").alias("y"), "correlation")
    mirror = pairs.select(F.col("column1").alias("x"), F.col("column2").alias("y"), "correlation")
    return cells.unionByName(mirror).unionByName(diagonal).select(
        "x", "y", "correlation", F.abs("correlation").alias("abs_correlation"),
        matrix_strength(F.col("correlation")).alias("strength"),
    )


def matrix_range(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.min("correlation").alias("min_value"), F.max("correlation").alias("max_value"))


def correlation_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs at or above the threshold with p, significance and strength."""
    return with_p_value(pairs.filter(F.abs("correlation") >= threshold)).withColumn(
        "strength", matrix_strength(F.col("correlation")))


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with |r| at or above 0.7 (high) or 0.9 (very high)."""
    return pairs.filter(F.abs("correlation") >= threshold).select(
        F.col("column1").alias("feature1"), F.col("column2").alias("feature2"), "correlation",
        matrix_strength(F.col("correlation")).alias("strength"))


def collinear_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with |r| above 0.8; above 0.95 they are CRITICAL."""
    critical = F.abs("correlation") > 0.95
    return pairs.filter(F.abs("correlation") > 0.8).select(
        "column1", "column2", "correlation",
        F.when(critical, "CRITICAL").otherwise("HIGH").alias("redundancy_level"),
        F.when(critical, F.concat(F.lit("Consider removing "), F.col("column2")))
        .otherwise("Consider removing one of the features").alias("recommendation"),
    )


def strength_distribution(pairs: DataFrame) -> DataFrame:
    """One row: pairs per strength band."""
    a = F.abs("correlation")
    return pairs.agg(
        F.count_if(a > 0.9).alias("very_strong"), F.count_if((a > 0.7) & (a <= 0.9)).alias("strong"),
        F.count_if((a > 0.5) & (a <= 0.7)).alias("moderate"), F.count_if((a > 0.3) & (a <= 0.5)).alias("weak"),
        F.count_if(a <= 0.3).alias("very_weak"),
    )


def correlation_statistics(pairs: DataFrame) -> DataFrame:
    """One row on |r| over all pairs (population std); the input is k*k rows."""
    a = F.abs("correlation")
    return pairs.agg(
        F.avg(a).alias("mean_correlation"), F.max(a).alias("max_correlation"), F.min(a).alias("min_correlation"),
        F.median(a).alias("median_correlation"), F.stddev_pop(a).alias("std_correlation"),
        F.count(F.lit(1)).alias("total_pairs"),
    )


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Every pair from both sides: feature, other, correlation."""
    one = pairs.select(F.col("column1").alias("feature"), F.col("column2").alias("other"), "correlation")
    two = pairs.select(F.col("column2").alias("feature"), F.col("column1").alias("other"), "correlation")
    return one.union(two)


def _vif_labels(scored: DataFrame) -> DataFrame:
    vif = F.col("vif_score")
    return scored.select(
        "feature", "vif_score", vif_severity(vif).alias("severity"),
        F.when(vif > 10, "High multicollinearity").when(vif > 5, "Moderate multicollinearity")
        .otherwise("Acceptable").alias("status"),
        F.when(vif > 10, "CRITICAL: Remove this feature or its correlated counterpart")
        .when(vif > 5, "WARNING: Consider feature selection or dimensionality reduction")
        .otherwise("OK: Feature multicollinearity is acceptable").alias("recommendation"),
    )


def vif(pairs: DataFrame) -> DataFrame:
    """Approximate inflation factor per feature.

    R² is taken as the mean squared r with the other features; the score is
    1 / (1 - R² + 0.0001), or 100 from R² 0.9999 on.  See ``vif_exact`` for the
    textbook value.  A constant feature scores as uncorrelated.
    """
    r2 = F.coalesce(F.avg(F.col("correlation") ** 2), F.lit(0.0))
    score = F.when(F.col("r2") >= 0.9999, F.lit(100.0)).otherwise(1 / (1 - F.col("r2") + 0.0001))
    return _vif_labels(_mirrored(pairs).groupBy("feature").agg(r2.alias("r2")).withColumn("vif_score", score))


def _matrix_of(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    order = pd.concat([frame[["i", "column1"]].set_axis(["p", "c"], axis=1),
                       frame[["j", "column2"]].set_axis(["p", "c"], axis=1)]).drop_duplicates().sort_values("p")
    names = order["c"].tolist()
    at = {c: x for x, c in enumerate(names)}
    m = np.eye(len(names))
    for a, b, r in zip(frame["column1"], frame["column2"], frame["correlation"]):
        m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if r is None or np.isnan(r) else r
    return names, m


def vif_exact(pairs: DataFrame) -> DataFrame:
    """Inflation factors as the diagonal of the inverse correlation matrix.

    The matrix has one row per column of the table, so one task holds it.
    """
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames))
        if len(frame):
            names, m = _matrix_of(frame)
            yield pd.DataFrame({"feature": names, "vif_score": np.diag(np.linalg.pinv(m))})

    return _vif_labels(pairs.repartition(1).mapInPandas(solve, "feature string, vif_score double"))


def problem_features(scores: DataFrame) -> DataFrame:
    """Features whose severity is not OK, worst first."""
    return scores.filter("severity <> 'OK'").select("feature", "vif_score", "severity").orderBy(
        F.col("vif_score").desc(), "feature")


def collinearity_level(scores: DataFrame) -> DataFrame:
    """One row: HIGH with any CRITICAL, MODERATE with over two WARNING, else LOW."""
    return scores.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    ).withColumn("level", F.when(F.col("critical") > 0, "HIGH").when(F.col("warnings") > 2, "MODERATE").otherwise("LOW"))


def ward_groups(distance: np.ndarray, cut: float) -> list[int]:
    """Ward linkage on a k*k distance matrix, cut at a height; group number per item.

    Groups are numbered from 1 in the order of their first member.
    """
    k = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    members: dict[int, list[int]] = {i: [i] for i in range(k)}
    while len(members) > 1:
        alive = sorted(members)
        sub = d[np.ix_(alive, alive)]
        flat = int(np.argmin(sub))
        s, t = alive[flat // len(alive)], alive[flat % len(alive)]
        height = d[s, t]
        if height > cut:
            break
        ns, nt = len(members[s]), len(members[t])
        for v in alive:
            if v not in (s, t):
                nv = len(members[v])
                near = ((nv + ns) * d[v, s] ** 2 + (nv + nt) * d[v, t] ** 2 - nv * height ** 2) / (nv + ns + nt)
                d[s, v] = d[v, s] = np.sqrt(max(near, 0.0))
        members[s] += members.pop(t)
        d[t, :] = d[:, t] = np.inf
    number = {}
    for g, group in enumerate(sorted(members.values(), key=min), start=1):
        number.update({i: g for i in group})
    return [number[i] for i in range(k)]


def feature_clusters(pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Features grouped by Ward linkage on 1 - |r|: feature, cluster.

    Spark computes the k*k matrix; the linkage on it runs in one task, bounded
    by the number of columns.  An undefined r counts as distance 1.
    """
    def cluster(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames))
        if len(frame):
            names, m = _matrix_of(frame)
            yield pd.DataFrame({"feature": names, "cluster": ward_groups(1 - np.abs(m), cut)})

    return pairs.repartition(1).mapInPandas(cluster, "feature string, cluster int")


def relationship_insights(pairs: DataFrame, top: int = 5) -> DataFrame:
    """Strongest positive and negative pairs (top of each) and all uncorrelated ones."""
    shape = [F.col("column1").alias("feature1"), F.col("column2").alias("feature2"), "correlation"]

    def best(frame: DataFrame, kind: str) -> DataFrame:
        return frame.orderBy(F.abs("correlation").desc(), "i", "j").limit(top).select(F.lit(kind).alias("kind"), *shape)

    r = F.col("correlation")
    return best(pairs.filter(r > 0.7), "strongest_positive").union(
        best(pairs.filter(r < -0.7), "strongest_negative")).union(
        pairs.filter(F.abs(r) < 0.1).select(F.lit("uncorrelated").alias("kind"), *shape))


def feature_connectivity(pairs: DataFrame) -> DataFrame:
    """Per feature: how many of the others have |r| above 0.5, as number and share."""
    return _mirrored(pairs).groupBy("feature").agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.abs("correlation") > 0.5).alias("strongly_correlated"),
    ).withColumn("connectivity_score", share(F.col("strongly_correlated"), F.col("total_features")))


def collinearity_warnings(pairs: DataFrame, top_pairs: int = 10) -> DataFrame:
    """Features with a high score, then the pairs above 0.8 (the first ten by position).

    ``pair_count`` is the number of all such pairs.
    """
    bad = vif(pairs).filter("severity <> 'OK'").select(
        F.lit("HIGH_VIF").alias("type"), "severity", "feature", F.lit(None).cast("string").alias("other"),
        F.col("vif_score").alias("score"), F.lit(None).cast("bigint").alias("pair_count"))
    high = pairs.filter(F.abs("correlation") > 0.8)
    total = high.agg(F.count(F.lit(1)).alias("n"))
    shown = high.orderBy("i", "j").limit(top_pairs).select(
        F.lit("HIGH_CORRELATION_PAIRS").alias("type"),
        F.when(F.abs("correlation") > 0.9, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.col("column1").alias("feature"), F.col("column2").alias("other"), F.col("correlation").alias("score"),
        total.scalar().alias("pair_count"))
    return bad.union(shown)


def collinearity_assessment(warnings: DataFrame) -> DataFrame:
    """One row: number of warnings (all pairs make one) and the verdict."""
    count = F.count_if(F.col("type") == "HIGH_VIF") + F.max(
        F.when(F.col("type") == "HIGH_CORRELATION_PAIRS", 1).otherwise(0))
    return warnings.agg(F.coalesce(count, F.lit(0)).alias("warning_count")).withColumn(
        "overall_assessment",
        F.when(F.col("warning_count") == 0, "No significant multicollinearity issues detected")
        .when(F.col("warning_count") == 1, "Minor multicollinearity issues detected")
        .otherwise("Significant multicollinearity issues detected - action recommended"))


def complete_analysis(df: DataFrame, threshold: float = 0.3) -> dict[str, DataFrame]:
    """Every report from one pass over the data: the pairs are persisted (k*k rows).

    Unpersist ``result["pairs"]`` when done.
    """
    names = numeric_columns(df)
    pairs = pair_correlations(df, names, listwise=True).persist()
    matrix = correlation_matrix(pairs, names)
    scores = vif(pairs)
    warnings = collinearity_warnings(pairs)
    return {
        "pairs": pairs, "matrix": matrix, "matrix_range": matrix_range(matrix),
        "correlation_pairs": correlation_pairs(pairs, threshold), "high": strong_pairs(pairs, 0.7),
        "very_high": strong_pairs(pairs, 0.9), "collinear": collinear_pairs(pairs),
        "strength_distribution": strength_distribution(pairs), "statistics": correlation_statistics(pairs),
        "vif": scores, "problem_features": problem_features(scores), "level": collinearity_level(scores),
        "clusters": feature_clusters(pairs), "insights": relationship_insights(pairs),
        "connectivity": feature_connectivity(pairs), "warnings": warnings,
        "assessment": collinearity_assessment(warnings),
    }
