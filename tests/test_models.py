import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from editpulse.operators import evaluate as Q
from editpulse.operators.sampling import stratified_folds, with_places
from editpulse.plans import grouping as G
from editpulse.plans import linear_search as L
from editpulse.plans import retention as M

SMALL_FOREST = {"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 5, "featureSubsetStrategy": "0.3", "class_weight": "balanced"}


@pytest.fixture(scope="module")
def summary(spark):
    """600 users; `signal` decides who leaves early, `noise` does not."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        signal, noise = float(rng.random()), float(rng.random())
        rows.append((i, bool(signal < 0.3), signal, noise, None if i % 5 else 1.5, "C%d" % (i % 4), "building"))
    return spark.createDataFrame(
        rows,
        "user_id bigint, left_early boolean, signal double, noise double, days_to_50 double, top_country string, top_feature_type_name string",
    )


def test_forest_pipeline(spark, summary):
    fitted = M.forest_pipeline(summary, [SMALL_FOREST])
    assert "signal" in fitted.features
    ranked = [r["feature"] for r in M.feature_importance(fitted).collect()]
    assert ranked[0] == "signal"
    row = M.result_row(fitted, "Random Forest").first()
    assert row["Model"] == "Random Forest" and row["Precision_True"] > 0.9 and row["Recall_False"] > 0.9
    assert sum(r["n"] for r in M.test_confusion(fitted).collect()) == 120
    drops = {r["feature"]: r["importance"] for r in M.permutation_importance(fitted).collect()}
    assert drops["signal"] > 0.2 and drops["signal"] == max(drops.values())


def test_permutation_is_a_permutation(spark, summary):
    rows = summary.select("user_id", F.col("signal").alias("own"))
    places = sorted(r["place"] for r in with_places(rows, "user_id", 5).collect())
    assert places == list(range(1, 601))


def test_search_and_learning_curve(spark, summary):
    table = M.training_table(summary, "tree")
    draws = [{**SMALL_FOREST, "maxDepth": 1, "numTrees": 1}, SMALL_FOREST]
    best, scored = M.tune_forest(table, draws)
    assert len(scored) == 2 and best in draws and all(0 <= score <= 1 for _, score in scored)
    curve = M.learning_curve(table, lambda: M.make_forest(SMALL_FOREST), ["signal"], "balanced", [0.5, 1.0], 2).collect()
    assert len(curve) == 2 and all(r["validation_mean"] > 0.8 for r in curve)


def test_scaled_rows_are_not_written_again(summary):
    scaled, names, _ = M.linear_rows(summary, 3)
    assert len(names) == 3 and all("editpulse-training-linear" in path for path in scaled.inputFiles())


def test_linear_pipeline(spark, summary):
    draws = [L.Draw("log_loss", alpha, "l2", 0.0, (4.0, 1.0), False, 1e-4) for alpha in (1e-3, 10.0)]
    fitted = M.linear_pipeline(summary, draws, k=3)
    assert fitted.threshold == 0.25 and len(fitted.features) == 3 and fitted.model.draw == draws[0]
    assert M.coefficients(fitted, 1).first()["feature"] == "signal"
    row = M.result_row(fitted, "Linear").first()
    assert row["Recall_True"] > 0.9
    report = M.linear_report(summary, draws, k=3).collect()
    assert [r["draw"] for r in report] == [0, 1] and report[0]["f1"] > report[1]["f1"]


def test_every_gap_is_filled_and_flagged(summary):
    odd = summary.withColumn("deleted_keys_ratio", F.when(F.col("user_id") % 3 > 0, F.lit(0.5))).withColumn("unlisted", F.when(F.col("user_id") % 7 > 0, F.lit(1.5)))
    table = M.training_table(odd, "linear")
    for name in ("deleted_keys_ratio", "unlisted", "days_to_50"):
        assert {r[0] for r in table.where(F.col(f"{name}_missing") == 1).select(name).distinct().collect()} == {9999.0}
    sizes = table.groupBy("left_early", "fold").count().groupBy("left_early").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("n")).collect()
    assert all(r["d"] <= 1 and r["n"] == 3 for r in sizes)


def test_draws_repeat():
    assert M.forest_draws(15) == M.forest_draws(15) and len({repr(d) for d in M.forest_draws(15)}) == 15
    draws = L.linear_draws()
    assert len(draws) == 50 and draws == L.linear_draws() and all(1e-6 <= d.alpha <= 1e-3 for d in draws)
    assert {d.loss for d in draws} == set(L.LOSSES) and {d.penalty for d in draws} == set(L.PENALTIES)


def test_small_classes_have_folds(spark):
    df = spark.createDataFrame([(k, "a" if k else "b") for k in range(3)] + [(9, None)], "user_id bigint, t string")
    folds = {r["user_id"]: r["fold"] for r in stratified_folds(df, "t", 3).collect()}
    assert len(folds) == 4 and all(0 <= f < 3 for f in folds.values()) and folds[1] != folds[2]


@pytest.fixture(scope="module")
def scaled(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[-4, 0, 0, 0], [4, 0, 0, 0], [0, 6, 0, 0]])
    rows = [(i, *(float(x) for x in rng.normal(size=4) * [1, 1, 0.1, 0.1] + centers[i % 3])) for i in range(300)]
    return spark.createDataFrame(rows, "user_id bigint, a double, b double, c double, d double")


def test_components_reach_the_share(spark, scaled):
    shares = G.explained_variance(scaled).orderBy("component").collect()
    kept = [r for r in shares if r["kept"]]
    assert len(kept) == 2 and kept[-1]["cumulative"] >= 0.9 > kept[0]["cumulative"]
    assert G.loadings(scaled).count() == 4 * 2


def test_users_with_a_missing_feature_stay(spark):
    columns = "user_id bigint, total_edits bigint, left_early boolean, days_to_50 double, active_duration bigint, odd double, plain double"
    rows = [(i, 50, False, 3.0, 10, None if i % 10 == 0 else float(i), float(i * i % 17)) for i in range(50)]
    scaled = G.scaled_users(spark.createDataFrame(rows, columns))
    components = G.components(scaled)
    assert scaled.count() == components.count() == 50
    assert G.assign(G.fit_kmeans(components, 2, 2), components, "group").distinct().count() == 50


def test_groups_are_found(spark, scaled):
    rows = G.components(scaled)
    metrics = G.kmeans_sweep(rows, None, (2, 3, 5), restarts=2).orderBy("k").collect()
    inertia = [r["inertia"] for r in metrics]
    assert inertia == sorted(inertia, reverse=True)
    frame = spark.createDataFrame(metrics)
    assert Q.best_by_score(frame).first()["best_k"] == 3 and Q.elbow_choice(frame).first()["best_k"] == 3
    sizes = G.assign(G.fit_kmeans(rows, 3, 3), rows, "group").groupBy("group").count().collect()
    assert [r["count"] for r in sizes] == [100, 100, 100]
    mixture = G.mixture_sweep(rows, (2, 3))
    assert mixture.count() == 2
    labelled = G.labelled_users(scaled, G.assign(G.fit_mixture(rows, 3), rows, "group"))
    assert labelled.count() == 300
    profile = Q.cluster_profile(labelled, ["a", "b", "c", "d"], "group", top=2)
    assert {r["feature"] for r in profile.collect()} == {"a", "b"}
    assert rows.select(F.size(vector_to_array("features"))).first()[0] == 2
