import statistics

import pytest
from pyspark.sql import functions as F

from editpulse.operators import features as P
from editpulse.operators import ranking as K
from editpulse.operators import sampling as R


def test_running_sums_match_brute_force(spark):
    rows = [("a", (i * 37) % 50, 1 + i % 3) for i in range(300)] + [("b", i, 2) for i in range(40)] + [("b", None, 9)]
    df = spark.createDataFrame(rows, "s string, v int, w int")
    got = K.running_sums(df, "v", {"w_sum": F.col("w")}, "s", slices=7).collect()
    for row in got:
        mine = [(v, w) for s, v, w in rows if s == row["s"] and v is not None]
        assert row["w_sum_upto"] == sum(w for v, w in mine if v <= row["v"])
        assert row["w_sum"] == sum(w for v, w in mine if v == row["v"])
        assert row["w_sum_all"] == sum(w for _, w in mine)
    assert len(got) == 50 + 40


def test_running_sums_with_one_dominant_value(spark):
    rows = [(5.0,)] * 200 + [(float(i),) for i in range(100)]
    df = spark.createDataFrame(rows, "v double")
    got = {r["v"]: r["n_upto"] for r in K.running_sums(df, "v", {"n": F.lit(1)}, slices=16).collect()}
    assert got[4.0] == 5 and got[5.0] == 206 and got[99.0] == 300


def test_medians(spark):
    values = [3.0, 1.0, 2.0, 10.0, None, 7.5, 7.5]
    df = spark.createDataFrame([(v, None if v is None else v * 2) for v in values[:-1]], "a double, b double")
    present = [v for v in values[:-1] if v is not None]
    medians = K.exact_medians(df, ["a", "b"])
    assert medians == {"a": statistics.median(present), "b": 2 * statistics.median(present)}


def test_split_sizes_are_exact_per_class(spark):
    df = spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") % 7 == 0).alias("left_early"))
    split = R.stratified_split(df, "left_early")
    sizes = {r["left_early"]: r["n"] for r in split.where("is_test").groupBy("left_early").agg(F.count("*").alias("n")).collect()}
    assert sizes == {True: round(143 * 0.2), False: round(857 * 0.2)}
    again = R.stratified_split(df.repartition(5), "left_early")
    assert split.where("is_test").exceptAll(again.where("is_test")).count() == 0


def test_samples(spark):
    df = spark.range(500).withColumnRenamed("id", "user_id")
    assert R.sample_rows(df, 123).count() == 123
    assert R.sample_rows(df, 123).distinct().count() == 123
    assert R.sample_rows(df, 9999).count() == 500
    drawn = R.resample_rows(df, 700)
    assert drawn.count() == 700 and 320 < drawn.distinct().count() < 420
    assert drawn.exceptAll(R.resample_rows(df.repartition(7), 700)).count() == 0
    folds = df.select(R.fold_number(3).alias("fold")).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2] and min(r["count"] for r in folds) > 100


def test_corrected_skewness(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    profile = {r["feature"]: r for r in P.skew_profile(df, ["a", "b"]).collect()}
    assert profile["a"]["skew"] == pytest.approx(1.763632614803888)
    assert profile["a"]["transform"] == "z" and profile["b"]["transform"] == "z"


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(i, float(v), 4.0) for i, v in enumerate([0, 0, 0, 0, 0, 0, 0, 0, 100])], "user_id int, x double, c double")
    rows = P.scale_features(df).orderBy("user_id").collect()
    import numpy as np

    x = np.log1p([0.0] * 8 + [100.0])
    expected = (x - x.mean()) / x.std()
    assert [r["x_scaled"] for r in rows] == pytest.approx(list(expected))
    assert {r["c_scaled"] for r in rows} == {0.0}


def test_imputation(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 5, None), (3, 7, 3.0)], "user_id int, days_to_50 int, top_feature_ratio double")
    rows = {r["user_id"]: r for r in P.impute_medians(P.impute_sentinels(df)).collect()}
    assert rows[1]["days_to_50"] == 9999 and rows[1]["days_to_50_missing"] == 1
    assert rows[2]["top_feature_ratio"] == 2.0 and rows[2]["top_feature_ratio_missing"] == 1
    assert rows[3]["days_to_50_missing"] == 0


def test_frequency_encoding_ignores_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "user_id int, top_country string")
    rows = {r["user_id"]: r["top_country_encoded"] for r in P.frequency_encode(df).collect()}
    assert rows == {1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(1 / 3), 4: None}


def test_class_weights(spark):
    df = spark.createDataFrame([(True,)] * 3 + [(False,)], "left_early boolean")
    rows = {r["left_early"]: r["class_weight"] for r in P.class_weights(df).collect()}
    assert rows == {True: pytest.approx(4 / 6), False: pytest.approx(2.0)}


def test_mutual_information_of_copy_and_constant(spark):
    import math

    df = spark.range(400).select((F.col("id") % 2 == 0).alias("left_early"), (F.col("id") % 2).alias("copy"), F.lit(1).alias("constant"))
    scores = {r["feature"]: r["mutual_info"] for r in P.mutual_information(df, ["copy", "constant"]).collect()}
    assert scores["copy"] == pytest.approx(math.log(2)) and scores["constant"] == pytest.approx(0.0)


def test_grouping_input_keeps_the_misspelt_column(spark):
    names = ["user_id", "total_edits", "left_early", "streetcomplete_changeset_ratio", "days_to_50", "active_duration", "days_to_100",
             "burstiness_score", "comment_length_ratio", "top_feature_ratio"]
    schema = ", ".join(f"{n} {'boolean' if n == 'left_early' else 'double'}" for n in names)
    rows = [(1.0, 11.0, False, 0.5, None, 4.0, None, None, None, None), (2.0, 10.0, False, *[1.0] * 7), (3.0, 50.0, True, *[1.0] * 7)]
    (row,) = P.grouping_input(spark.createDataFrame(rows, schema)).collect()
    assert row["streetcomplete_changeset_ratio"] == 0.5 and row["days_to_50"] == 5.0 and row["burstiness_score"] == 0.0
    assert "days_to_100" not in row.asDict()
