"""Grouping established users: scaling, PCA, KMeans and Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.operators import evaluate as Q
from editpulse.operators.features import grouping_input, scale_features
from editpulse.plans import clustering as C
from editpulse.sources.staging import stage

SEED = 42
# Ranges and limits of the published grouping
VARIANCE_SHARE = 0.9
CLUSTER_RANGE = range(2, 16)
RESTARTS = 20
SILHOUETTE_SAMPLE = 10_000
MIXTURE_RANGE = range(2, 20)
IMPROVEMENT_LIMIT = 0.015
PARALLEL_FITS = 4


def scaled_users(summary: DataFrame) -> DataFrame:
    """Scaled features of all established users, written once for the many fits on them.

    A feature that is still missing after ``grouping_input`` takes 0, the mean of the scaled feature,
    so no user is left out.
    """
    scaled = scale_features(grouping_input(summary))
    return stage(scaled.fillna(0.0, [name for name in scaled.columns if name != "user_id"]), "scaled-users")


def _assembled(scaled: DataFrame, key: str = "user_id") -> tuple[DataFrame, list[str]]:
    names = [name for name in scaled.columns if name != key]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(scaled), names


def fit_components(scaled: DataFrame, share: float = VARIANCE_SHARE) -> tuple[PCAModel, list[str], int]:
    """PCA with all components, and how many of them reach the variance share."""
    rows, names = _assembled(scaled)
    model = PCA(k=len(names), inputCol="features", outputCol="components").fit(rows)
    reached, kept = 0.0, 0
    for variance in model.explainedVariance.toArray():
        reached, kept = reached + variance, kept + 1
        if reached >= share:
            break
    return model, names, kept


Reduction = tuple[PCAModel, list[str], int]


def explained_variance(scaled: DataFrame, fitted: Reduction | None = None) -> DataFrame:
    """Variance share per component, its running sum and whether the component is kept."""
    model, _, kept = fitted or fit_components(scaled)
    total, rows = 0.0, []
    for place, variance in enumerate(model.explainedVariance.toArray(), 1):
        total += float(variance)
        rows.append((place, float(variance), total, place <= kept))
    return scaled.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double, kept boolean")


def loadings(scaled: DataFrame, fitted: Reduction | None = None) -> DataFrame:
    """Weight of every feature in every kept component, one row per feature and component."""
    model, names, kept = fitted or fit_components(scaled)
    weights = model.pc.toArray()
    rows = [(name, f"PC{c + 1}", float(weights[f, c])) for f, name in enumerate(names) for c in range(kept)]
    return scaled.sparkSession.createDataFrame(rows, "feature string, component string, loading double")


def components(scaled: DataFrame, fitted: Reduction | None = None) -> DataFrame:
    """``user_id, features`` with the kept components, written once for the sweeps."""
    model, _, kept = fitted or fit_components(scaled)
    rows, _ = _assembled(scaled)
    projected = model.transform(rows).withColumn("kept", F.slice(vector_to_array("components"), 1, kept))
    return stage(as_vectors(projected.select("user_id", "kept"), "kept"), "components")


def as_vectors(df: DataFrame, array: str) -> DataFrame:
    others = [name for name in df.columns if name != array]
    return df.select(*others, array_to_vector(F.col(array)).alias("features"))


def _points(rows: DataFrame, key: str = "user_id") -> DataFrame:
    return rows.select(key, vector_to_array("features").alias("point"))


def _scanned(points: DataFrame, key: str = "user_id") -> DataFrame:
    """Points in blocks, written once for the many scans of a fit."""
    return stage(C.packed(C.points_of(points, "point", key)), "points")


def fit_kmeans(rows: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> C.KMeansFit:
    """Best of several restarts by inertia; the earliest wins ties."""
    return C.fit_kmeans(_scanned(_points(rows)), [k], restarts, seed)[k]


def side_by_side(fit: Callable, settings: Sequence) -> list:
    """Independent fits from a few driver threads, so that small jobs share the cluster."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(fit, settings))


def assign(model: C.KMeansFit | C.MixtureFit, rows: DataFrame, column: str, key: str = "user_id") -> DataFrame:
    return C.label_rows(_points(rows, key), model, column, "point", key)


def kmeans_sweep(
    rows: DataFrame, sample_size: int | None, ks: Sequence[int] = CLUSTER_RANGE, restarts: int = RESTARTS, key: str = "user_id"
) -> DataFrame:
    """Quality measures per number of clusters, over all rows.

    ``silhouette`` compares all pairs of a sample of ``sample_size`` rows (all rows for None), once for all
    numbers; ``squared_silhouette`` and the other measures are linear and read every row, which is written
    once with its labels of all numbers.
    """
    points = _points(rows, key)
    dimensions = points.select(F.size("point")).first()[0]
    fits = C.fit_kmeans(_scanned(points, key), list(ks), restarts, SEED)

    labelled = stage(C.label_points(points, [fits[k] for k in ks], "point", key), "labelled")
    pairs = {r["grouping"]: r["silhouette"] for r in Q.silhouettes(labelled, len(ks), sample_size).collect()}  # one row a number of clusters

    def measured(place: int) -> tuple:
        own = labelled.select("key", F.col("clusters")[place].alias("cluster"), "point")
        return (
            ks[place],
            pairs[place],
            Q.squared_silhouette(own).first()[0],
            Q.davies_bouldin(own, dimensions).first()[0],
            Q.calinski_harabasz(own, dimensions).first()[0],
            fits[ks[place]].inertia,
        )

    results = side_by_side(measured, range(len(ks)))
    return rows.sparkSession.createDataFrame(
        results, "k int, silhouette double, squared_silhouette double, davies_bouldin double, calinski_harabasz double, inertia double"
    )


def fit_mixture(rows: DataFrame, n: int, seed: int = SEED) -> C.MixtureFit:
    return C.fit_mixtures(_scanned(_points(rows)), [n], seed)[n]


def mixture_sweep(rows: DataFrame, counts: Sequence[int] = MIXTURE_RANGE) -> DataFrame:
    """BIC and AIC per number of mixture components; all models share each scan."""
    total = rows.count()
    fits = C.fit_mixtures(_scanned(_points(rows)), list(counts), SEED)
    results = [(n, *Q.information_criteria(fit.log_likelihood, n, fit.means.shape[1], total)) for n, fit in fits.items()]
    return rows.sparkSession.createDataFrame(results, "n_components int, bic double, aic double")


def labelled_users(scaled: DataFrame, labels: DataFrame) -> DataFrame:
    """Scaled features with the group label of every user."""
    return scaled.join(labels, "user_id")


def group_users(
    summary: DataFrame,
    ks: Sequence[int] = CLUSTER_RANGE,
    counts: Sequence[int] = MIXTURE_RANGE,
    restarts: int = RESTARTS,
    fixed_k: int | None = None,
    fixed_n: int | None = None,
    criterion: str = "bic",
    sample_size: int | None = SILHOUETTE_SAMPLE,
) -> dict[str, DataFrame]:
    """The whole grouping job; numbers of groups are chosen unless given."""
    scaled = scaled_users(summary)
    fitted = fit_components(scaled)
    rows = components(scaled, fitted)
    tables = {"loadings": loadings(scaled, fitted)}
    if fixed_k is None:
        tables["kmeans_metrics"] = kmeans_sweep(rows, sample_size, ks, restarts)
        tables["elbow"] = Q.elbow_choice(tables["kmeans_metrics"])
        fixed_k = Q.best_by_score(tables["kmeans_metrics"]).first()["best_k"]
    if fixed_n is None:
        tables["mixture_metrics"] = mixture_sweep(rows, counts)
        fixed_n = Q.improvement_choice(tables["mixture_metrics"], value=criterion, threshold=IMPROVEMENT_LIMIT).first()["best_n"]
    features = [name for name in scaled.columns if name != "user_id"]
    for name, model in (("kmeans", fit_kmeans(rows, fixed_k, restarts)), ("gmm", fit_mixture(rows, fixed_n))):
        labelled = labelled_users(scaled, assign(model, rows, f"cluster_{name}"))
        tables[f"{name}_users"] = labelled
        tables[f"{name}_profile"] = Q.cluster_profile(labelled, features, f"cluster_{name}")
    return tables
