import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from editpulse.operators import summary as U

FEATURE_SUMS = [c for c in U.TOTALS if c not in ("edit_count",)]
START = date(2020, 1, 5)  # a Sunday


@pytest.fixture()
def daily(spark):
    def make(*rows):
        """Rows of (user, country, day offset, edits[, overrides])."""
        names = ["user_id", "country", "edit_date", "edit_count", *FEATURE_SUMS]
        data = []
        for user, country, offset, edits, *extra in rows:
            values = dict.fromkeys(FEATURE_SUMS, 0) | {"total_changesets_per_day": 1} | (extra[0] if extra else {})
            data.append((user, country, START + timedelta(days=offset), edits, *(values[c] for c in FEATURE_SUMS)))
        doubles = {"total_days_valid", "total_changeset_duration_per_day_in_sec"}
        schema = ", ".join(
            f"{n} {'string' if n == 'country' else 'date' if n == 'edit_date' else 'double' if n in doubles else 'bigint'}"
            for n in names
        )
        return spark.createDataFrame([tuple(float(v) if n in doubles else v for n, v in zip(names, row)) for row in data], schema)

    return make


def by_user(df):
    return {r["user_id"]: r for r in df.collect()}


def test_column_counts(daily):
    rows = daily((1, "A", 0, 1))
    assert len(U.prediction_summary(rows).columns) == 64
    assert len(U.categorization_summary(rows).columns) == 67


def test_window_keeps_day_180_and_drops_day_181(daily):
    row = by_user(U.prediction_summary(daily((1, "A", 0, 1), (1, "A", 180, 1), (1, "A", 181, 1))))[1]
    assert row["true_edit_days"] == 2 and row["total_edits"] == 2 and row["active_duration"] == 180
    assert row["full_last_edit"] == START + timedelta(days=181)


def test_left_early_border(daily):
    result = by_user(U.categorization_summary(daily((1, "A", 0, 1), (1, "A", 179, 1), (2, "A", 0, 1), (2, "A", 180, 1))))
    assert result[1]["left_early"] is True and result[2]["left_early"] is False


def test_cohort_border(daily):
    snapshot = str(START + timedelta(days=180))
    result = by_user(U.prediction_summary(daily((1, "A", 0, 1), (2, "A", 1, 1)), snapshot=snapshot))
    assert set(result) == {1}


def test_one_day_user(daily):
    row = by_user(U.categorization_summary(daily((1, "A", 0, 5))))[1]
    assert row["active_duration"] == 0 and row["activity_ratio_true"] is None and row["burstiness_score"] is None
    assert row["pause_after_first_edit"] is None and row["pause_after_first_editing_day"] is None
    assert row["mean_days_between_edits_true"] is None and row["entropy_country_distribution"] == 0.0
    assert row["diversity_score"] == 0.0


def test_two_countries_on_the_first_day(daily):
    row = by_user(U.categorization_summary(daily((1, "A", 0, 1), (1, "B", 0, 1), (1, "A", 4, 1))))[1]
    assert row["pause_after_first_edit"] == 0 and row["pause_after_first_editing_day"] == 4
    assert row["true_edit_days"] == 2


def test_country_tie_and_entropy(daily):
    row = by_user(U.categorization_summary(daily((1, "B", 0, 9), (1, "A", 1, 9))))[1]
    assert row["top_country"] == "A" and row["number_of_countries"] == 2
    assert row["entropy_country_distribution"] == 1.0
    assert row["diversity_score"] == pytest.approx(0.5 * math.log10(19))


def test_top_feature(daily):
    tie = {"count_building_per_day": 2, "count_road_per_day": 2, "count_waterway_per_day": 1}
    rows = daily((1, "A", 0, 5), (2, "A", 0, 5, tie))
    result = by_user(U.categorization_summary(rows))
    assert result[1]["top_feature_type_name"] == "none" and result[1]["top_feature_ratio"] is None
    assert result[2]["top_feature_type_name"] == "building" and result[2]["feature_category_count"] == 3
    assert result[2]["top_feature_ratio"] == pytest.approx(0.4)


def test_no_changesets_gives_null_ratios(daily):
    row = by_user(U.categorization_summary(daily((1, "A", 0, 5, {"total_changesets_per_day": 0}))))[1]
    assert row["edits_per_changeset_ratio"] is None and row["keys_per_changeset_ratio"] is None


def test_milestones_and_early_ratios(daily):
    row = by_user(U.prediction_summary(daily((1, "A", 0, 30), (1, "B", 3, 15), (1, "A", 3, 10), (1, "A", 20, 45), (1, "A", 90, 1))))[1]
    assert row["days_to_50"] == 3 and row["days_to_100"] == 20
    assert row["frontload_ratio"] == pytest.approx(55 / 100) and row["early_days_ratio"] == pytest.approx(2 / 3)
    row = by_user(U.prediction_summary(daily((1, "A", 0, 30))))[1]
    assert row["days_to_50"] is None


def test_weeks_start_on_monday(daily):
    row = by_user(U.categorization_summary(daily((1, "A", 0, 1), (1, "A", 1, 1), (1, "A", 7, 1), (1, "A", 8, 1))))[1]
    # Sunday | Monday .. Sunday | Monday
    assert row["active_weeks"] == 3 and row["active_week_ratio"] == pytest.approx(1.0)


def test_burstiness(daily):
    row = by_user(U.categorization_summary(daily((1, "A", 0, 1), (1, "A", 1, 1), (1, "A", 4, 1))))[1]
    spread, mean = math.sqrt(2), 2.0
    assert row["burstiness_score"] == pytest.approx((spread - mean) / (spread + mean))
    row = by_user(U.prediction_summary(daily((1, "A", 0, 1), (1, "A", 1, 1), (1, "A", 4, 1))))[1]
    assert row["burstiness"] == pytest.approx(spread)


def test_days_are_partitioned_by_user_once(daily):
    plan = U.day_features(U.user_days(daily((1, "A", 0, 1))))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(user_id") <= 2 and initial.count("Window [") <= 1


def test_labels_need_no_daily_table(spark):
    start = date(2001, 1, 1)
    edits = [(user, "A" if k % 2 else "B", start + timedelta(days=(user * 37 + k * user * 11) % 260)) for user in range(1, 30) for k in range(user % 5 + 1)]
    rows = spark.createDataFrame([*edits, *edits[:9], (None, "A", start)], "user_id long, country string, edit_date date")
    daily = rows.groupBy("user_id", "country", "edit_date").agg(F.count(F.lit(1)).alias("edit_count"))
    daily = daily.select("*", *(F.lit(1).alias(name) for name in U.TOTALS if name != "edit_count"))
    for source in (rows, daily):
        expected = U.prediction_summary(daily, snapshot="2001-12-31").select("user_id", "left_early")
        got = U.retention_labels(source, snapshot="2001-12-31")
        assert sorted(got.collect()) == sorted(expected.collect()) and 0 < got.count() < 29
        whole = U.categorization_summary(daily).select("user_id", "total_edits", "left_early")
        assert sorted(U.lifetimes(source).drop("first_edit").collect()) == sorted(whole.collect())
