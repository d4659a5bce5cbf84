"""Predicting who leaves early: Spark ML classifiers on a user summary."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.functions import rules
from editpulse.operators import features as P
from editpulse.operators.evaluate import classification_report, confusion_matrix
from editpulse.operators.sampling import row_hash, sample_rows, stratified_folds, stratified_split, with_places
from editpulse.plans import linear_search as L
from editpulse.sources.staging import stage

TARGET = "left_early"
TREE_FILL = -999.0
SEED = 42

# --------------------------------------------------------------------------
# Search spaces and limits of the published models
# --------------------------------------------------------------------------
FOREST_SPACE = {
    "numTrees": [100, 200],
    "maxDepth": [10, 15, 20],
    "minInstancesPerNode": [5, 10, 20],
    "featureSubsetStrategy": ["log2", "0.2", "0.3"],
    "class_weight": ["balanced", {False: 2.0, True: 1.0}, {False: 3.0, True: 1.0}],
}
FOREST_DRAWS = 15
TUNING_ROWS = 500_000
IMPORTANCE_LIMIT = 0.01
LINEAR_FEATURES = 35
THRESHOLD = 0.25
FOLDS = 3
PARALLEL_FITS = 4
LEARNING_SHARES = [0.1 + 0.9 * step / 7 for step in range(8)]

#: Summary columns that may be missing, beside those with a published fill: too few days, or no edit that
#: tells the values before and after.
LINEAR_SENTINELS = (
    "burstiness", "new_keys_ratio", "deleted_keys_ratio", "keys_per_changeset_ratio", "edits_per_changeset_ratio",
    "changeset_duration_ratio", "changesets_per_edit_day", "avg_days_valid_per_edit", "activity_ratio_true", "frontload_ratio", "early_days_ratio",
)


# ------------------------------------------------------------------ tables
def training_table(summary: DataFrame, missing: str) -> DataFrame:
    """Encoded, imputed summary with target, ``is_test`` and ``fold``, written once for all fits.

    ``missing`` is ``"tree"`` (one out-of-range fill) or ``"linear"``: flagged sentinels and medians, and a
    flagged sentinel as well for any other feature that some user lacks.
    """
    table = P.frequency_encode(summary)
    if missing == "linear":
        table = P.impute_medians(P.impute_sentinels(table, [*rules.SENTINEL_COLUMNS, *LINEAR_SENTINELS]))
        gaps = table.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in P.model_features(table))).first().asDict()
        table = P.impute_sentinels(table, [name for name, n in gaps.items() if n])
    table = stratified_folds(stratified_split(table, TARGET), TARGET, FOLDS)
    names = P.model_features(table)
    if missing == "tree":
        table = table.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(TREE_FILL)) for name in names})
    return stage(table.withColumns({name: F.col(name).cast("double") for name in names}), f"training-{missing}")


def with_vector(table: DataFrame, names: Sequence[str]) -> DataFrame:
    label = F.col(TARGET).cast("double").alias("label")
    assembled = VectorAssembler(inputCols=list(names), outputCol="features").transform(table)
    kept = [c for c in ("user_id", TARGET, "is_test", "fold", "class_weight") if c in table.columns]
    return assembled.select(*kept, label, "features")


def train_rows(table: DataFrame) -> DataFrame:
    return table.where(~F.col("is_test"))


def test_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("is_test"))


def predictions(model: Model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Truth, probability of leaving early, and the thresholded decision."""
    scored = model.transform(rows).withColumn("probability_true", vector_to_array("probability")[1])
    return scored.select("user_id", TARGET, "probability_true", (F.col("probability_true") >= threshold).alias("predicted"))


# ------------------------------------------------------------------ search
class ReportScore(Evaluator):
    """F1 from the confusion counts: macro average, or of one class."""

    def __init__(self, label: str | None = None):
        super().__init__()
        self.label = label or "macro avg"

    def _evaluate(self, dataset: DataFrame) -> float:
        decided = dataset.select((F.col("label") == 1).alias("truth"), (F.col("prediction") == 1).alias("decided"))
        rows = classification_report(decided, "truth", "decided").where(F.col("label") == self.label).collect()
        return float(rows[0]["f1"]) if rows else 0.0

    def isLargerBetter(self) -> bool:
        return True


def forest_draws(count: int, space: dict = FOREST_SPACE, seed: int = SEED) -> list[dict]:
    """Distinct random settings from the grid."""
    grid = [{}]
    for name, choices in space.items():
        grid = [{**setting, name: choice} for setting in grid for choice in choices]
    return random.Random(seed).sample(grid, min(count, len(grid)))


def _weighted(rows: DataFrame, weights) -> DataFrame:
    return P.class_weights(rows, TARGET, None if weights == "balanced" else weights)


def tune(
    make: Callable[[dict], Estimator], rows: DataFrame, draws: Sequence[dict], evaluator: Evaluator, parallelism: int = PARALLEL_FITS
) -> tuple[dict, list[tuple[dict, float]]]:
    """Cross-validated search: best setting, and every setting with its mean score.

    Class weights are those of the rows that a fit sees, so balanced ones are computed for each fold.
    """

    def measured(job: tuple[dict, int]) -> float:
        setting, fold = job
        model = make(setting).fit(_weighted(rows.where(F.col("fold") != fold), setting["class_weight"]))
        return evaluator.evaluate(model.transform(rows.where(F.col("fold") == fold)))

    jobs = [(setting, fold) for setting in draws for fold in range(FOLDS)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(measured, jobs))
    scored = [(setting, sum(scores[FOLDS * k : FOLDS * (k + 1)]) / FOLDS) for k, setting in enumerate(draws)]
    return max(scored, key=lambda entry: entry[1])[0], scored


def make_forest(setting: dict) -> RandomForestClassifier:
    params = {name: value for name, value in setting.items() if name != "class_weight"}
    return RandomForestClassifier(seed=SEED, weightCol="class_weight", bootstrap=True, **params)


# ------------------------------------------------------------------ fitted models
@dataclass
class Fitted:
    model: Model | L.LinearModel
    features: list[str]
    table: DataFrame
    seconds: float
    threshold: float = 0.5

    def test_predictions(self) -> DataFrame:
        if isinstance(self.model, L.LinearModel):
            scored = test_rows(self.table).select("user_id", TARGET, self.model.probability().alias("probability_true"))
            return scored.withColumn("predicted", F.col("probability_true") >= self.threshold)
        return predictions(self.model, with_vector(test_rows(self.table), self.features), self.threshold)


def fit_forest(table: DataFrame, setting: dict, names: Sequence[str] | None = None) -> Fitted:
    names = list(names or P.model_features(table))
    rows = _weighted(with_vector(train_rows(table), names), setting["class_weight"])
    start = time.perf_counter()
    model = make_forest(setting).fit(rows)
    return Fitted(model, names, table, time.perf_counter() - start)


def tune_forest(table: DataFrame, draws: Sequence[dict], max_rows: int = TUNING_ROWS) -> tuple[dict, list]:
    names = P.model_features(table)
    rows = stage(with_vector(sample_rows(train_rows(table), max_rows), names), "tuning")
    return tune(make_forest, rows, draws, ReportScore())


def feature_importance(fitted: Fitted) -> DataFrame:
    """Impurity importance per feature, highest first."""
    scores = [(n, float(s)) for n, s in zip(fitted.features, fitted.model.featureImportances.toArray())]
    frame = fitted.table.sparkSession.createDataFrame(scores, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def important_features(fitted: Fitted, limit: float = IMPORTANCE_LIMIT) -> list[str]:
    return [row["feature"] for row in feature_importance(fitted).where(F.col("importance") > limit).collect()]


def forest_pipeline(summary: DataFrame, draws: Sequence[dict]) -> Fitted:
    """Tune, keep the important features, refit on them."""
    table = training_table(summary, "tree")
    setting = draws[0] if len(draws) == 1 else tune_forest(table, draws)[0]
    selected = important_features(fit_forest(table, setting))
    return fit_forest(table, setting, selected)


def linear_rows(summary: DataFrame, k: int = LINEAR_FEATURES) -> tuple[DataFrame, list[str], DataFrame]:
    """Table with the ``k`` features that tell most about the target, scaled, their names, and the training rows for scans.

    The scaler is fitted on the training rows only and applied to all rows.
    """
    table = training_table(summary, "linear")
    scores = P.mutual_information(train_rows(table), P.model_features(table), TARGET)
    names = [row["feature"] for row in P.best_features(scores, k).collect()]
    scaled = P.zscore(table, names, fit_on=train_rows(table))  # a projection of the written table, so no copy of it is written
    return scaled, names, stage(L.packed(L.design(train_rows(scaled), names, TARGET), len(names)), "design")


def linear_pipeline(summary: DataFrame, draws: Sequence[L.Draw], k: int = LINEAR_FEATURES) -> Fitted:
    """Select by mutual information, scale, tune on F1 of those who stay, decide at the low threshold."""
    scaled, names, rows = linear_rows(summary, k)
    start = time.perf_counter()
    best = draws[0]
    if len(draws) > 1:
        best = draws[max(L.search(rows, draws, len(names)), key=lambda s: (s["f1"], -s["draw"]))["draw"]]
    model = L.fit_draw(rows, best, names)
    return Fitted(model, names, scaled, time.perf_counter() - start, THRESHOLD)


def linear_report(summary: DataFrame, draws: Sequence[L.Draw], k: int = LINEAR_FEATURES) -> DataFrame:
    """Recall, precision and F1 of those who stay for every draw, the best first."""
    _, names, rows = linear_rows(summary, k)
    return L.search_report(rows, L.search(rows, draws, len(names)))


def coefficients(fitted: Fitted, top: int = 20) -> DataFrame:
    """Largest coefficients by absolute value."""
    pairs = [(n, float(c)) for n, c in zip(fitted.features, fitted.model.coefficients)]
    frame = fitted.table.sparkSession.createDataFrame(pairs, "feature string, coefficient double")
    return frame.orderBy(F.desc(F.abs("coefficient")), "feature").limit(top)


def result_row(fitted: Fitted, name: str) -> DataFrame:
    """One-row report: run times, precision and recall per class, rounded to two places."""
    start = time.perf_counter()
    decided = stage(fitted.test_predictions(), "predictions")
    seconds = time.perf_counter() - start
    report = classification_report(decided, TARGET, "predicted")

    def score(label: str, column: str):
        return F.round(F.max(F.when(F.col("label") == label, F.col(column))), 2)

    return report.agg(
        F.first(F.lit(name)).alias("Model"),
        F.first(F.lit(round(fitted.seconds, 2))).alias("Train_Time_sec"),
        F.first(F.lit(round(seconds, 2))).alias("Predict_Time_sec"),
        score("false", "precision").alias("Precision_False"),
        score("false", "recall").alias("Recall_False"),
        score("true", "precision").alias("Precision_True"),
        score("true", "recall").alias("Recall_True"),
    )


def learning_curve(
    table: DataFrame, make: Callable[[], Estimator], names: Sequence[str], weights, shares: Sequence[float] = tuple(LEARNING_SHARES), folds: int = FOLDS
) -> DataFrame:
    """Macro F1 on training and held-out rows for growing shares of the training rows."""
    rows = stage(_weighted(with_vector(train_rows(table), names), weights), "curve")
    position = F.conv(F.substring(row_hash("user_id", SEED + 2), 1, 8), 16, 10).cast("long") / F.lit(float(16**8))
    score = ReportScore()
    measured = []
    for share in shares:
        for fold in range(folds):
            taken = rows.where((F.col("fold") != fold) & (position < share))
            model = make().fit(taken)
            held_out = rows.where(F.col("fold") == fold)
            measured.append((float(share), fold, score.evaluate(model.transform(taken)), score.evaluate(model.transform(held_out))))
    frame = table.sparkSession.createDataFrame(measured, "share double, fold int, train_f1 double, validation_f1 double")
    return frame.groupBy("share").agg(
        F.avg("train_f1").alias("train_mean"),
        F.stddev_pop("train_f1").alias("train_std"),
        F.avg("validation_f1").alias("validation_mean"),
        F.stddev_pop("validation_f1").alias("validation_std"),
    )


# ------------------------------------------------------------------ permutation importance
def permutation_importance(fitted: Fitted, rows: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Drop of macro F1 when one feature is exchanged between users.

    Each row is paired with the row at the same place of a second hash order, and for every feature one
    copy of the row takes the donor's value.  All copies are scored by one pass over the
    model, so there is no loop over features.
    """
    rows = test_rows(fitted.table) if rows is None else rows
    base = stage(
        with_vector(rows, fitted.features).select("user_id", TARGET, vector_to_array("features").alias("own")), "permuted"
    )
    left = with_places(base, "user_id", seed)
    right = with_places(base, "user_id", seed + 1).select("place", F.col("own").alias("donor"))
    paired = left.join(right, "place")
    copies = paired.withColumn("feature_index", F.explode(F.sequence(F.lit(-1), F.lit(len(fitted.features) - 1)))).select(
        "user_id",
        TARGET,
        "feature_index",
        array_to_vector(F.expr("transform(own, (x, i) -> CASE WHEN i = feature_index THEN donor[i] ELSE x END)")).alias("features"),
    )
    scored = fitted.model.transform(copies).withColumn(
        "predicted", vector_to_array("probability")[1] >= fitted.threshold
    )
    cells = scored.groupBy("feature_index", TARGET, "predicted").agg(F.count(F.lit(1)).alias("n"))
    f1 = [
        F.try_divide(
            2 * F.sum(F.when((F.col(TARGET) == value) & (F.col("predicted") == value), F.col("n")).otherwise(0)),
            F.sum(
                F.when(F.col(TARGET) == value, F.col("n")).otherwise(0)
                + F.when(F.col("predicted") == value, F.col("n")).otherwise(0)
            ),
        )
        for value in (False, True)
    ]
    scores = cells.groupBy("feature_index").agg(((F.coalesce(f1[0], F.lit(0.0)) + F.coalesce(f1[1], F.lit(0.0))) / 2).alias("f1"))
    names = table_of_names(fitted)
    baseline = F.max(F.when(F.col("feature_index") == -1, F.col("f1")))
    gathered = scores.agg(baseline.alias("base_f1"), F.collect_list(F.struct("feature_index", "f1")).alias("scores"))
    return (
        gathered.select("base_f1", F.inline("scores"))
        .join(F.broadcast(names), "feature_index")
        .select("feature", (F.col("base_f1") - F.col("f1")).alias("importance"))
    )


def table_of_names(fitted: Fitted) -> DataFrame:
    return fitted.table.sparkSession.createDataFrame(list(enumerate(fitted.features)), "feature_index int, feature string")


def test_confusion(fitted: Fitted) -> DataFrame:
    return confusion_matrix(fitted.test_predictions(), TARGET, "predicted")
