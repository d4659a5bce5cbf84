"""Feature preparation on the user summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from editpulse.functions import rules
from editpulse.operators.ranking import as_series, exact_medians, running_sums
from editpulse.sources.staging import stage


def class_balance(df: DataFrame, target: str = "left_early") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_users"))


def class_weights(df: DataFrame, target: str = "left_early", weights: dict | None = None) -> DataFrame:
    """Add ``class_weight``: given weights, or n / (classes x n of the class) by default."""
    if weights is None:
        counts = stage(class_balance(df, target), "classes").withColumnRenamed(target, "weighted_class")
        total, classes = counts.agg(F.sum("n_users"), F.count(F.lit(1))).first()
        balanced = counts.select("weighted_class", (F.lit(float(total or 0)) / (F.lit(classes) * F.col("n_users"))).alias("class_weight"))
        return df.join(balanced, F.col(target).eqNullSafe(F.col("weighted_class")), "left").drop("weighted_class")
    weight = F.lit(None).cast("double")
    for value, number in weights.items():
        weight = F.when(F.col(target) == value, F.lit(float(number))).otherwise(weight)
    return df.withColumn("class_weight", weight)


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share of every category among the rows that have one."""
    counts = stage(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "categories")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(column, (F.col("n") / F.lit(total)).alias("frequency"))


def frequency_encode(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Replace category columns by the share of their value; a missing value stays NULL."""
    for column, encoded in (columns or rules.ENCODED_CATEGORIES).items():
        if column in df.columns:
            shares = category_frequency(df, column).withColumnRenamed("frequency", encoded)
            df = df.join(shares, column, "left").drop(column)
    return df


def _with_missing_flag(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    flags = {f"{name}_missing": F.col(name).isNull().cast("int") for name in fills}
    filled = {name: F.coalesce(F.col(name).cast("double"), F.lit(float(value))) for name, value in fills.items()}
    return df.withColumns(flags | filled) if fills else df


def impute_sentinels(df: DataFrame, columns: Sequence[str] = rules.SENTINEL_COLUMNS) -> DataFrame:
    """Fill values whose absence has a meaning with a sentinel, plus a missing flag."""
    present = [name for name in columns if name in df.columns]
    return _with_missing_flag(df, dict.fromkeys(present, rules.SENTINEL_VALUE))


def impute_medians(df: DataFrame, columns: Sequence[str] = rules.MEDIAN_COLUMNS) -> DataFrame:
    """Fill with the exact median, plus a missing flag."""
    present = [name for name in columns if name in df.columns]
    return _with_missing_flag(df, exact_medians(df, present))


def model_features(df: DataFrame) -> list[str]:
    """Numeric columns a classifier may use."""
    skipped = {*rules.MODEL_ID_COLUMNS, "is_test", "class_weight", "fold"}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skipped]


# ------------------------------------------------------------------ mutual information
def mutual_information(df: DataFrame, features: Sequence[str], target: str = "left_early", bins: int = 20) -> DataFrame:
    """Mutual information (nats) of each feature with a binary target.

    Values are ranked exactly and cut into ``bins`` groups of equal size; equal values
    share a group.  All features are handled in one pass over the long form.
    """
    long = as_series(df, features, target)
    ranked = running_sums(long, "value", {"n": F.lit(1), "hits": F.col(target).cast("int")}, "feature")
    group = F.floor((F.col("n_upto") - F.col("n")) * bins / F.col("n_all"))
    cells = (
        ranked.groupBy("feature", group.alias("bin"), "n_all", "hits_all")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        .select("feature", "n", "n_all", F.expr("inline(array(named_struct('cell', hits, 'side', hits_all), named_struct('cell', n - hits, 'side', n_all - hits_all)))"))
    )
    information = F.expr("sum(CASE WHEN cell > 0 THEN cell / n_all * ln(cell * n_all / (n * side)) ELSE 0D END)")
    return cells.groupBy("feature").agg(information.alias("mutual_info"))


def best_features(scores: DataFrame, k: int, score: str = "mutual_info") -> DataFrame:
    """The ``k`` highest scores; names break ties."""
    return scores.orderBy(F.desc(score), "feature").limit(k)


# ------------------------------------------------------------------ grouping features
def established_users(summary: DataFrame, min_edits: int = 10) -> DataFrame:
    return summary.where((F.col("total_edits") > min_edits) & ~F.col("left_early"))


def grouping_input(summary: DataFrame) -> DataFrame:
    """Established users with the columns used for grouping, missing values filled.

    The user id is kept so that a cluster label can be traced back to its user.
    """
    kept = established_users(summary).drop(*(c for c in rules.GROUPING_DROPPED if c != "user_id"))
    fills: dict[str, Column] = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in rules.ZERO_FILLED}
    fills["days_to_50"] = F.coalesce(F.col("days_to_50"), F.col("active_duration") + 1)
    return kept.withColumns({name: fill for name, fill in fills.items() if name in kept.columns})


def numeric_features(df: DataFrame, key: str = "user_id") -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != key]


def skew_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, range and bias-corrected skewness per feature, with the transform they call for.

    The long form is summed up per feature before the shuffle. Four aggregates for each of 40-odd columns
    at once would make methods that the JVM does not compile.
    """
    rows = as_series(df, features).groupBy("feature").agg(
        F.count("value").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.nanvl(F.skewness("value"), F.lit(None).cast("double")).alias("population_skew"),
    )
    n = F.col("n").cast("double")
    corrected = F.when(n > 2, F.col("population_skew") * F.sqrt(n * (n - 1)) / (n - 2))
    plain = (F.col("low") >= 0) & (F.col("high") <= 1.5)
    return rows.withColumn("skew", corrected).withColumn(
        "transform", F.when(plain, "z").when(F.col("skew") > 2, "log1p_z").otherwise("z")
    )


def _moments(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a deviation of nothing but rounding counts as 1."""
    long = as_series(df.select(*(value.alias(name) for name, value in values.items())), list(values))
    found = {r["feature"]: r for r in long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")).collect()}
    moments = {}
    for name in values:
        if name in found and found[name]["mean"] is not None:
            mean, spread = found[name]["mean"], found[name]["spread"]
            moments[name] = (mean, spread if spread > 1e-12 * max(1.0, abs(mean)) else 1.0)
    return moments


def scale_features(df: DataFrame, features: Sequence[str] | None = None, key: str = "user_id") -> DataFrame:
    """``<feature>_scaled`` columns: optional log1p, then z-scores with the population deviation.

    Two aggregations give the transform and the moments of all features (a few numbers per feature reach
    the driver, as in any fitted scaler); the rows themselves only pass a projection.
    """
    features = list(features or numeric_features(df, key))
    found = {r["feature"]: r["transform"] == "log1p_z" for r in skew_profile(df, features).collect() if r["n"] > 0}
    logged = {name: found[name] for name in features if name in found}
    values = {name: F.log1p(name) if log else F.col(name).cast("double") for name, log in logged.items()}
    moments = _moments(df, values) if values else {}
    return df.select(
        key,
        *(((values[name] - F.lit(mean)) / F.lit(spread)).alias(f"{name}_scaled") for name, (mean, spread) in moments.items()),
    )


def zscore(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace columns by z-scores with the population deviation, fitted on ``fit_on``."""
    moments = _moments(df if fit_on is None else fit_on, {name: F.col(name) for name in features})
    return df.withColumns({name: (F.col(name) - F.lit(mean)) / F.lit(spread) for name, (mean, spread) in moments.items()})
