"""Feature preparation, batch scoring, explanations, splits and model fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, ratio
from ..functions.numbers import confidence_band, key_number, sigmoid, zscore
from ..session import scratch_path
from .joins import join_lookup
from .projection import align_columns
from .ranking import dense_index, group_quantiles


def sparse_vector(size: int, places: Column, values: Column) -> Column:
    """A sparse vector of ML without a name for any place of it.

    Spark ML's encoder and assembler list all places as attributes on the
    driver.  Only JSON is read into a vector type, so the parts go through it.
    """
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), places.alias("indices"), values.alias("values"))
    schema = T.StructType([T.StructField("vector", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("vector"))), schema, {"mode": "FAILFAST"})["vector"]


@dataclass(frozen=True)
class FittedPreparation:
    """A fitted pipeline; what its wide text columns hold stays in written tables (value, code).

    ``widths`` has how many places a wide column takes.
    """

    model: PipelineModel
    numeric: Sequence[str]
    categorical: Sequence[str]
    dictionaries: Mapping[str, DataFrame]
    widths: Mapping[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``: the scaled numbers, then a sparse block per text column.

        A block's last place stands for a missing or unseen value.
        """
        out = self.model.transform(df)
        if not self.dictionaries:
            blocks = ["scaled", *[f"{c}__hot" for c in self.categorical]]
            out = VectorAssembler(inputCols=blocks, outputCol="features").transform(out)
            # The assembler names every place; nothing after it needs the names, which grow with the categories.
            return out.withColumn("features", F.col("features").alias("features", metadata={}))
        for i, (c, table) in enumerate(self.dictionaries.items()):
            coded = table.select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
            out = join_lookup(out, coded, col(c).cast("string") == F.col(f"_value{i}"))
            code = F.coalesce(F.col(f"_code{i}"), F.lit(self.widths[c] - 1)).cast("double")
            out = out.withColumn(f"{c}__code", code).drop(f"_value{i}", f"_code{i}")
            hot = sparse_vector(self.widths[c], F.array(col(f"{c}__code").cast("int")), F.array(F.lit(1.0)))
            out = out.withColumn(f"{c}__hot", hot)
        widths = dict(self.widths)
        for stage in self.model.stages:
            if isinstance(stage, StringIndexerModel):
                widths |= {c: len(labels) + 1 for c, labels in zip(stage.getInputCols(), stage.labelsArray)}
        start, places = len(self.numeric), []
        for c in self.categorical:
            places.append((col(f"{c}__code") + start).cast("int"))
            start += widths[c]
        # As the assembler does, without the zeros among the numbers.
        scaled = vector_to_array("scaled")
        given = F.filter(F.sequence(F.lit(0), F.lit(len(self.numeric) - 1)), lambda i: F.get(scaled, i) != 0)
        numbers = F.filter(scaled, lambda x: x != 0)
        ones = F.array(*[F.lit(1.0) for _ in places])
        return out.withColumn("features", sparse_vector(start, F.concat(given, F.array(*places)), F.concat(numbers, ones)))

    def columns(self, df: DataFrame, keep: Sequence[str], expected: Sequence[str]) -> DataFrame:
        """``keep``, then exactly the columns a model expects, in its order.

        A number is asked for by its name, a category as ``{column}_{value}``.
        What the training data did not hold is 0.
        """
        out = self.model.transform(df)
        scaled = vector_to_array("scaled")
        found = {c: scaled[i] for i, c in enumerate(self.numeric) if c in expected}
        seen = {c: labels for stage in self.model.stages if isinstance(stage, StringIndexerModel)
                for c, labels in zip(stage.getInputCols(), stage.labelsArray)}
        for c in sorted(self.categorical, key=len):
            asked = [e[len(c) + 1:] for e in expected if e.startswith(f"{c}_")]
            if c in self.dictionaries and asked:
                # As many values as the model has columns at most.
                seen[c] = [r.value for r in self.dictionaries[c].filter(F.col("value").isin(asked)).select("value").collect()]
            known = set(seen.get(c, ()))
            for value in asked:
                if value in known:
                    found[f"{c}_{value}"] = F.coalesce((col(c).cast("string") == F.lit(value)).cast("double"), F.lit(0.0))
        out = out.select(*[col(k) for k in keep], *[value.alias(name) for name, value in found.items()])
        return align_columns(out, [*keep, *expected])


def fit_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                 most_categories: int = 10_000) -> FittedPreparation:
    """Impute, one-hot encode and scale with Spark ML, ending in ``features``.

    The string indexer keeps a column's distinct values on the driver.  A column
    of over ``most_categories`` values, as a sketch counts them, gets its codes
    from a table instead, which is written under the shared folder and joined, and
    the vectors have no attributes; both ways give the same vectors.  Errors of any step surface.
    """
    wide: list[str] = []
    if categorical:
        sizes = train.agg(*[F.approx_count_distinct(col(c)).alias(f"_{i}") for i, c in enumerate(categorical)]).first()
        wide = [c for i, c in enumerate(categorical) if sizes[i] > most_categories]
    narrow = [c for c in categorical if c not in wide]
    numbers = [f"{c}__number" for c in numeric]
    stages = [Imputer(inputCols=list(numeric), outputCols=numbers, strategy="mean")]
    if narrow:
        codes = [f"{c}__code" for c in narrow]
        stages += [
            StringIndexer(inputCols=narrow, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=codes, outputCols=[f"{c}__hot" for c in narrow], handleInvalid="keep"),
        ]
    stages += [
        VectorAssembler(inputCols=numbers, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]
    model = Pipeline(stages=stages).fit(train)
    dictionaries, widths = {}, {}
    spark = train.sparkSession
    for c in wide:
        path = scratch_path(spark, "categories")
        dense_index(train.select(col(c).cast("string").alias("value")), "value").write.parquet(path)
        dictionaries[c] = spark.read.parquet(path)
        widths[c] = dictionaries[c].count() + 1
    return FittedPreparation(model, list(numeric), list(categorical), dictionaries, widths)


@dataclass(frozen=True)
class ManualPreparation:
    """What ``fit_manual`` learned: a few numbers, short lists, and code tables that stay distributed."""

    scales: Mapping[str, tuple[float | None, float | None]]
    one_hot: Mapping[str, list[str]]
    codes: Mapping[str, DataFrame]


def fit_manual(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
               most_one_hot: int = 10) -> ManualPreparation:
    """Learn means, deviations and categories from the training table.

    A text column with at most ``most_one_hot`` values is one-hot encoded (only
    those few values come to the driver); a wider one gets integer codes.
    """
    scales = {}
    if numeric:
        row = train.agg(*[f(col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(numeric)
                          for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        scales = {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(numeric)}
    one_hot, codes = {}, {}
    for c in categorical:
        few = [r[0] for r in train.select(col(c)).filter(col(c).isNotNull()).distinct().limit(most_one_hot + 1).collect()]
        if len(few) <= most_one_hot:
            one_hot[c] = sorted(few)
        else:
            codes[c] = dense_index(train, c, "_code")
    return ManualPreparation(scales, one_hot, codes)


def transform_manual(df: DataFrame, prep: ManualPreparation, keep: Sequence[str] = (),
                     expected: Sequence[str] | None = None) -> DataFrame:
    """Apply a manual preparation.

    Numbers become ``{c}_scaled``; few-valued text one 0/1 column per category
    but the first; other text its code, -1 when unseen.  ``expected`` aligns the
    result to a model's input columns.
    """
    out = []
    for c, (mean, std) in prep.scales.items():
        out.append(zscore(col(c).cast("double"), F.lit(mean).cast("double"), F.coalesce(F.lit(std).cast("double"), F.lit(0.0)))
                   .alias(f"{c}_scaled"))
    for c, values in prep.one_hot.items():
        out += [F.coalesce((col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values[1:]]
    for i, (c, table) in enumerate(prep.codes.items()):
        coded = table.select(col(c).alias(f"_value{i}"), F.col("_code").alias(f"_code{i}"))
        df = join_lookup(df, coded, col(c) == F.col(f"_value{i}"))
        out.append(F.coalesce(F.col(f"_code{i}"), F.lit(-1)).cast("int").alias(c))
    result = df.select(*[col(k) for k in keep], *out)
    if expected is not None:
        result = align_columns(result, [*keep, *expected])
    return result


def probability_of(model_output: DataFrame, column: str = "probability") -> DataFrame:
    """Replace an ML probability vector by the positive class' probability."""
    return model_output.withColumn(column, vector_to_array(col(column))[1])


def linear_probability(features: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Sigmoid of a linear decision value."""
    total = F.lit(float(intercept))
    for name, weight in features.items():
        total = total + col(name).cast("double") * float(weight)
    return sigmoid(total)


def score_rows(df: DataFrame, probability: str, threshold: float = 0.5, positive: str = "1",
               negative: str = "0") -> DataFrame:
    """Add prediction, both probabilities, confidence and its band, for the whole batch at once."""
    p = col(probability)
    chosen = p >= F.lit(float(threshold))
    confidence = F.when(chosen, p).otherwise(1 - p)
    return df.select(
        "*", F.when(chosen, 1).otherwise(0).alias("prediction_class"),
        F.when(chosen, positive).otherwise(negative).alias("prediction"),
        F.round(p, 4).alias("probability_positive"), F.round(1 - p, 4).alias("probability_negative"),
        F.round(confidence, 4).alias("confidence"), confidence_band(confidence).alias("confidence_label"),
    )


def _contributions(weights: Mapping[str, float], top: int) -> Column:
    """Array of the ``top`` terms of a linear model, largest first, ties by position."""
    parts = []
    for i, (name, weight) in enumerate(weights.items()):
        term = col(name).cast("double") * float(weight)
        parts.append(F.struct(
            (-F.abs(term)).alias("order"), F.lit(i).alias("position"), F.lit(name).alias("feature"),
            term.alias("term"), col(name).cast("string").alias("value")))
    return F.slice(F.array_sort(F.array(*parts)), 1, top)


def contributions(df: DataFrame, key: str, weights: Mapping[str, float], top: int = 8) -> DataFrame:
    """The strongest terms per row: feature, contribution, impact, direction, rank.

    Sorted inside the row's own array; rows are never shuffled.
    """
    rows = df.select(col(key), F.posexplode(_contributions(weights, top)).alias("rank", "c"))
    size = F.abs(F.col("c.term"))
    return rows.select(
        col(key), (F.col("rank") + 1).alias("rank"), F.col("c.feature").alias("feature"),
        F.round(size, 4).alias("contribution"), F.round(size * 100, 1).alias("impact"),
        F.when(F.col("c.term") > 0, "positive").otherwise("negative").alias("direction"),
        F.col("c.value").alias("value"))


def importance_contributions(df: DataFrame, key: str, importances: Mapping[str, float], top: int = 8) -> DataFrame:
    """The most important features per row, for a model that only tells importances: feature, contribution, impact, direction, rank.

    The contribution is the feature's importance, the direction the sign of the
    row's value (null and zero are negative).  The order is the same for every
    row (ties as given), so nothing is sorted or shuffled.
    """
    chosen = sorted(importances.items(), key=lambda x: -x[1])[:top]
    terms = [
        F.struct(
            F.lit(i + 1).alias("rank"), F.lit(name).alias("feature"), F.lit(round(float(weight), 4)).alias("contribution"),
            F.lit(round(float(weight) * 100, 1)).alias("impact"),
            F.when(col(name).cast("double") > 0, "positive").otherwise("negative").alias("direction"), col(name).cast("string").alias("value"))
        for i, (name, weight) in enumerate(chosen)
    ]
    return df.select(col(key), F.inline(F.array(*terms)))


def model_importances(model: Transformer, features: Sequence[str]) -> dict[str, float]:
    """Feature importances of a fitted tree model of Spark ML, by the names that were assembled."""
    return dict(zip(features, (float(x) for x in model.featureImportances.toArray()), strict=True))


def explanations(df: DataFrame, key: str, weights: Mapping[str, float], prediction: str, top: int = 8) -> DataFrame:
    """A sentence per row: up to two supporting factors and one against."""
    rows = df.select(col(key), col(prediction).alias("_p"), _contributions(weights, top).alias("_c"))

    def named(test, count: int) -> Column:
        kept = F.slice(F.filter("_c", test), 1, count)
        return F.array_join(F.transform(kept, lambda c: F.concat(
            c["feature"], F.lit(" ("), F.coalesce(c["value"], F.lit("")), F.lit(")"))), ", ")

    rows = rows.withColumn("_for", named(lambda c: c["term"] > 0, 2)).withColumn(
        "_against", named(lambda c: ~(c["term"] > 0), 1))
    parts = F.concat_ws(
        ". ",
        F.when(F.col("_for") != "", F.concat(F.lit("Key factors supporting "), F.col("_p"), F.lit(": "), F.col("_for"))),
        F.when(F.col("_against") != "", F.concat(F.lit("Factors against: "), F.col("_against"))))
    return rows.select(col(key), F.when(parts != "", F.concat(parts, F.lit("."))).otherwise(
        F.concat(F.lit("Prediction: "), F.col("_p"))).alias("explanation"))


def batch_summary(scored: DataFrame, probability: str, prediction: str = "prediction_class") -> DataFrame:
    """One row: positive and negative counts, mean probability, high and low confidence counts."""
    p = col(probability)
    return scored.agg(
        F.count_if(col(prediction) == 1).alias("positive"), F.count_if(col(prediction) != 1).alias("negative"),
        F.round(F.avg(p), 4).alias("average_confidence"),
        F.count_if(F.abs(p - 0.5) > 0.3).alias("high_confidence"),
        F.count_if(F.abs(p - 0.5) <= 0.3).alias("low_confidence"), F.count(F.lit(1)).alias("total"))


def batch_status(validated: DataFrame) -> DataFrame:
    """One row on a validated batch: totals, successes, failures, progress."""
    return validated.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("error").isNull()).alias("successful_records"),
        F.count_if(F.col("error").isNotNull()).alias("failed_records"),
    ).withColumn("processed_records", F.col("successful_records") + F.col("failed_records")).withColumn(
        "progress", F.round(ratio(F.col("processed_records") * 100, F.col("total_records")), 1))


_SHARES = 64  # of a class, each with a copy of its cut


def split_rows(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` (train or test), the same for every run, stratified by label.

    A row's hash number decides.  The cut is the exact ``test_share`` quantile
    of the numbers within its class; a class may hold most of the table, which
    ``group_quantiles`` allows for.  Each cut is there ``_SHARES`` times, and a
    row looks for that of its number's share: where adaptive execution shuffles
    the rows for it, a class goes to that many tasks.
    """
    numbered = df.withColumn("_h", key_number(col(key), seed))
    cuts = group_quantiles(numbered.select(col(label), "_h"), [label], "_h", {"_cut": test_share})
    cuts = cuts.withColumnRenamed(label, "_label").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    same = col(label).eqNullSafe(F.col("_label")) & (F.col("_h") % _SHARES == F.col("_share"))
    joined = join_lookup(numbered, cuts, same)
    return joined.withColumn("split", F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")).drop(
        "_h", "_label", "_share", "_cut")


ESTIMATORS = {
    "LogisticRegression": lambda: LogisticRegression(maxIter=20),
    "LinearSVC": lambda: LinearSVC(maxIter=10),
    "DecisionTreeClassifier": lambda: DecisionTreeClassifier(seed=42),
    "RandomForestClassifier": lambda: RandomForestClassifier(seed=42),
    "GradientBoostingClassifier": lambda: GBTClassifier(maxIter=10, seed=42),
    "NaiveBayes": lambda: NaiveBayes(modelType="gaussian"),
    "KMeans": lambda: KMeans(k=2, seed=42),
}


def fit_score(train: DataFrame, test: DataFrame, algorithm: str, label: str = "label") -> DataFrame:
    """Fit one Spark ML estimator on ``features`` and add its score to ``test``.

    The score is the positive class' probability, or the sigmoid of the margin
    for a classifier without probabilities.  KMeans adds its cluster instead.
    """
    estimator = ESTIMATORS[algorithm]()
    if algorithm != "KMeans":
        estimator = estimator.setLabelCol(label)
    # Fitting reads the training rows many times.
    held = train.select("features", *([] if algorithm == "KMeans" else [label])).persist()
    try:
        model = estimator.fit(held)
    finally:
        held.unpersist()
    out = model.transform(test)
    if algorithm == "KMeans":
        return out.withColumnRenamed("prediction", "cluster")
    if "probability" in out.columns:
        score = vector_to_array(F.col("probability"))[1]
    else:
        score = sigmoid(vector_to_array(F.col("rawPrediction"))[1])
    return out.withColumn("score", score)
