"""Behavioural feature row per user from the daily table.

The daily table has one row per (user, country, day), so the rows of one user are bounded by
countries x calendar days no matter how many edits the user makes.  Windows run on
(user, day) rows, which are bounded by the calendar alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpulse.functions import expressions as X
from editpulse.functions import rules

HORIZON_DAYS = 180
MILESTONES = (50, 100)
EARLY_DAYS = (7, 30)

# daily column -> name of its total per user
TOTALS = {
    "edit_count": "total_edits",
    "count_created_per_day": "total_created",
    "count_deleted_per_day": "total_deleted",
    "count_tag_only_per_day": "total_tagged",
    "count_geom_only_per_day": "total_geometry",
    "count_tag_and_geom_per_day": "total_geometry_tag",
    "count_none_per_day": "total_none",
    **{f"count_{feature}_per_day": f"total_{feature}" for feature in rules.FEATURES},
    "count_node_per_day": "total_nodes",
    "count_way_per_day": "total_ways",
    "count_relation_per_day": "total_relations",
    "total_new_keys_per_day": "total_new_keys",
    "total_removed_keys_per_day": "total_deleted_keys",
    "total_changesets_per_day": "total_changesets",
    "total_changeset_duration_per_day_in_sec": "total_changeset_duration_in_sec",
    **{f"count_{name}_changesets_per_day": f"total_{name}_changesets" for name in rules.EDITOR_COLUMNS.values()},
    "total_comment_length_per_day": "total_comment_length",
    "total_days_valid": "total_days_valid",
}


# ------------------------------------------------------------------ cohort and window
def first_last_activity(daily: DataFrame) -> DataFrame:
    return daily.groupBy("user_id").agg(
        F.min("edit_date").alias("first_edit"), F.max("edit_date").alias("full_last_edit")
    )


def eligible_cohort(daily: DataFrame, snapshot: str = rules.COHORT_SNAPSHOT, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Users whose first edit lies at least ``horizon`` days before the snapshot."""
    return first_last_activity(daily).where(F.col("first_edit") <= F.date_sub(F.lit(snapshot).cast("date"), horizon))


def lifetimes(rows: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """``user_id``, ``first_edit``, ``total_edits`` and ``left_early`` over each user's whole lifetime.

    ``rows`` are daily rows or the enriched contributions themselves, whose totals need no daily table.
    """
    edits = F.sum("edit_count") if "edit_count" in rows.columns else F.count(F.lit(1))
    spans = rows.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.min("edit_date").alias("first_edit"), F.max("edit_date").alias("full_last_edit"), edits.alias("total_edits")
    )
    return spans.select("user_id", "first_edit", "total_edits", _left_early(horizon))


def retention_labels(rows: DataFrame, horizon: int = HORIZON_DAYS, snapshot: str = rules.COHORT_SNAPSHOT) -> DataFrame:
    """``user_id`` and ``left_early`` of the users of ``prediction_summary``, from ``rows`` as in ``lifetimes``."""
    eligible = F.col("first_edit") <= F.date_sub(F.lit(snapshot).cast("date"), horizon)
    return lifetimes(rows, horizon).where(eligible).select("user_id", "left_early")


def observation_window(daily: DataFrame, cohort: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Daily rows up to ``horizon`` days after the user's first edit, last day included."""
    starts = cohort.select("user_id", "first_edit")
    return (
        daily.join(starts, "user_id")
        .where(F.col("edit_date") <= F.date_add("first_edit", horizon))
        .drop("first_edit")
    )


# ------------------------------------------------------------------ per user and country
def user_country_sums(rows: DataFrame, columns: Sequence[str] = tuple(TOTALS)) -> DataFrame:
    """Totals, first and last day per user and country."""
    return rows.groupBy("user_id", "country").agg(
        F.min("edit_date").alias("min_date"),
        F.max("edit_date").alias("max_date"),
        *(F.sum(name).alias(TOTALS[name]) for name in columns),
    )


def days_per_country(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "country").agg(F.count_distinct("edit_date").alias("days_editing_country"))


def country_entropy(edits: Column) -> Column:
    """Entropy in bits of the country shares, over the country rows of one user.

    Uses H = log2(T) - sum(x log2 x) / T, so the total T needs no second pass.
    """
    total = F.sum(edits).cast("double")
    weighted = F.sum(F.when(edits > 0, edits * F.log2(edits)).otherwise(0.0))
    return F.round(F.when(total > 0, F.log2(total) - weighted / total), 4) + F.lit(0.0)


def top_country(edits: Column) -> Column:
    """Country with most edits, alphabetically first on ties."""
    return F.min(F.struct((-edits).alias("rank"), "country"))["country"]


def user_totals(country_sums: DataFrame) -> DataFrame:
    """Totals per user over the country rows, with the country concentration measures."""
    edits = F.col("total_edits")
    names = [name for name in TOTALS.values() if name in country_sums.columns]
    return country_sums.groupBy("user_id").agg(
        F.min("min_date").alias("first_edit"),
        F.max("max_date").alias("last_edit"),
        F.count("country").alias("number_of_countries"),
        F.max(edits).alias("max_country_edits"),
        country_entropy(edits).alias("entropy_country_distribution"),
        top_country(edits).alias("top_country"),
        *(F.sum(name).alias(name) for name in names),
    )


def feature_breadth(totals: DataFrame) -> DataFrame:
    """Number of feature types touched, their summed and largest count, and the largest's name."""
    counts = {feature: F.col(f"total_{feature}") for feature in rules.FEATURES}
    summed = sum(counts.values(), F.lit(0).cast("long"))
    largest = F.greatest(*counts.values())
    name = F.when(F.col("total_featuretype_edits") == 0, "none")
    for feature, count in counts.items():
        name = name.when(F.col("max_featuretype_count") == count, feature)
    return totals.withColumns(
        {
            "feature_category_count": sum(
                (F.when(count > 0, 1).otherwise(0).cast("long") for count in counts.values()), F.lit(0).cast("long")
            ),
            "total_featuretype_edits": summed,
            "max_featuretype_count": largest,
        }
    ).withColumn("top_feature_type_name", name.otherwise("unknown"))


# ------------------------------------------------------------------ per user and day
def user_days(rows: DataFrame) -> DataFrame:
    """One row per user and day: edits, and number of daily rows (countries)."""
    return rows.groupBy("user_id", "edit_date").agg(
        F.sum("edit_count").alias("edit_count"), F.count(F.lit(1)).alias("row_count")
    )


def day_sequence(days: DataFrame) -> DataFrame:
    """Running values over a user's days: first day, gap, rank, edits so far, week change.

    All of them share one partitioning and one sort.
    """
    by_day = W.partitionBy("user_id").orderBy("edit_date")
    so_far = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    day = F.col("edit_date")
    previous = F.lag(day).over(by_day)
    return days.withColumns(
        {
            "first_edit": F.min(day).over(so_far),
            "gap_days": F.datediff(day, previous),
            "day_number": F.row_number().over(by_day),
            "edits_so_far": F.sum("edit_count").over(so_far),
            "new_week": F.when(X.week_start(day) == X.week_start(previous), 0).otherwise(1),
        }
    )


def day_features(
    days: DataFrame,
    horizon: int | None = None,
    milestones: Sequence[int] = MILESTONES,
    early: Sequence[int] = EARLY_DAYS,
) -> DataFrame:
    """All time-based values per user in one aggregation over the day sequence.

    With a ``horizon`` only days up to that many days after the first edit count, while
    ``full_last_edit`` still covers the whole lifetime.
    """
    age = F.datediff("edit_date", "first_edit")
    inside = F.lit(True) if horizon is None else age <= horizon
    gap = F.when(inside, F.col("gap_days"))
    short, long = early

    def within(limit: int, value: Column) -> Column:
        return F.sum(F.when(inside & (age <= limit), value).otherwise(F.lit(0).cast("long")))

    one = F.lit(1).cast("long")
    second_gap = F.min(F.when(F.col("day_number") == 2, gap))
    return (
        day_sequence(days)
        .groupBy("user_id")
        .agg(
            F.min("first_edit").alias("first_edit"),
            F.max("edit_date").alias("full_last_edit"),
            F.max(F.when(inside, F.col("edit_date"))).alias("last_in_window"),
            F.sum(F.when(inside, one)).alias("true_edit_days"),
            F.sum(F.when(inside, F.col("new_week").cast("long"))).alias("active_weeks"),
            F.stddev(gap).alias("gap_stddev"),
            F.avg(gap).alias("gap_mean"),
            second_gap.cast("long").alias("pause_after_first_editing_day"),
            F.when(F.max(F.when(F.col("day_number") == 1, F.col("row_count"))) > 1, F.lit(0))
            .otherwise(second_gap)
            .cast("long")
            .alias("pause_after_first_edit"),
            *(
                F.min(F.when(inside & (F.col("edits_so_far") >= goal), age)).cast("long").alias(f"days_to_{goal}")
                for goal in milestones
            ),
            within(short, F.col("edit_count")).alias("early_edits_short"),
            within(long, F.col("edit_count")).alias("early_edits_long"),
            within(short, one).alias("early_days_short"),
            within(long, one).alias("early_days_long"),
        )
    )


def burstiness_score(features: DataFrame) -> Column:
    spread, mean = features["gap_stddev"], features["gap_mean"]
    return F.try_divide(spread - mean, spread + mean)


# ------------------------------------------------------------------ final feature rows
def _shares(names: dict[str, str], whole: str) -> list[Column]:
    return [X.ratio(F.col(total), F.col(whole)).alias(out) for out, total in names.items()]


def _country_features() -> list[Column]:
    top_share = X.ratio(F.col("max_country_edits"), F.col("total_edits"))
    return [
        top_share.alias("top_country_ratio"),
        F.col("entropy_country_distribution"),
        ((1 - top_share) * F.log10(F.col("total_edits") + 1)).alias("diversity_score"),
        F.col("number_of_countries"),
        F.col("max_country_edits"),
        F.col("top_country"),
    ]


def _edit_type_features() -> list[Column]:
    return _shares(
        {
            "created_ratio": "total_created",
            "deleted_ratio": "total_deleted",
            "tag_ratio": "total_tagged",
            "geometry_ratio": "total_geometry",
            "none_ratio": "total_none",
        },
        "total_edits",
    )


def _feature_type_features() -> list[Column]:
    return [
        *_shares({f"{feature}_ratio": f"total_{feature}" for feature in rules.FEATURES}, "total_edits"),
        F.col("feature_category_count"),
        X.ratio(F.col("max_featuretype_count"), F.col("total_featuretype_edits")).alias("top_feature_ratio"),
        F.col("top_feature_type_name"),
    ]


def _content_features() -> list[Column]:
    changesets = F.col("total_changesets")
    return [
        *_shares(
            {
                "node_ratio": "total_nodes",
                "way_ratio": "total_ways",
                "relation_ratio": "total_relations",
                "geometry_tag_ratio": "total_geometry_tag",
                "new_keys_ratio": "total_new_keys",
                "deleted_keys_ratio": "total_deleted_keys",
            },
            "total_edits",
        ),
        X.ratio(F.col("total_new_keys") + F.col("total_deleted_keys"), changesets).alias("keys_per_changeset_ratio"),
        *_shares(
            {
                "edits_per_changeset_ratio": "total_edits",
                "changeset_duration_ratio_in_sec": "total_changeset_duration_in_sec",
                **{f"{name}_changeset_ratio": f"total_{name}_changesets" for name in rules.EDITOR_COLUMNS.values()},
                "comment_length_ratio": "total_comment_length",
            },
            "total_changesets",
        ),
        X.ratio(changesets, F.col("true_edit_days")).alias("changesets_per_edit_day"),
        X.ratio(F.col("total_days_valid"), F.col("total_edits")).alias("avg_days_valid_per_edit"),
    ]


def _pace_features(activity_ratio: Column) -> list[Column]:
    duration = F.col("active_duration")
    return [
        F.col("active_duration"),
        activity_ratio.alias("activity_ratio_true"),
        X.ratio(F.col("total_edits"), F.col("true_edit_days")).alias("edits_per_day_true"),
        X.ratio(duration, F.col("true_edit_days") - 1).alias("mean_days_between_edits_true"),
    ]


def _milestone_features(milestones: Sequence[int]) -> list[Column]:
    return [
        *(F.col(f"days_to_{goal}") for goal in milestones),
        X.ratio(F.col("early_edits_short"), F.col("early_edits_long")).alias("frontload_ratio"),
        X.ratio(F.col("early_days_short"), F.col("early_days_long")).alias("early_days_ratio"),
    ]


def _left_early(horizon: int) -> Column:
    return (F.datediff("full_last_edit", "first_edit") < horizon).alias("left_early")


def _calendar(part) -> Column:
    return part("first_edit").cast("long")


def _assembled(totals: DataFrame, times: DataFrame, span_end: str) -> DataFrame:
    return times.join(feature_breadth(totals.drop("first_edit", "last_edit")), "user_id").withColumns(
        {"active_duration": F.datediff(span_end, "first_edit").cast("long")}
    )


def prediction_summary(
    daily: DataFrame,
    horizon: int = HORIZON_DAYS,
    snapshot: str = rules.COHORT_SNAPSHOT,
    milestones: Sequence[int] = MILESTONES,
    early: Sequence[int] = EARLY_DAYS,
) -> DataFrame:
    """Feature row over each eligible user's first ``horizon`` days."""
    times = day_features(user_days(daily), horizon, milestones, early)
    rows = first_days(daily.select("user_id", "country", "edit_date", *TOTALS), horizon, snapshot)
    return window_rows(user_totals(user_country_sums(rows)), times, horizon, snapshot, milestones)


def _latest_start(horizon: int, snapshot: str) -> Column:
    return F.date_sub(F.lit(snapshot).cast("date"), horizon)


def first_days(rows: DataFrame, horizon: int = HORIZON_DAYS, snapshot: str = rules.COHORT_SNAPSHOT) -> DataFrame:
    """The rows of eligible users up to ``horizon`` days after their first one.

    The first day is a window over the layout that the sums per user need anyway, so the cohort is not joined back.
    """
    first = F.min("edit_date").over(W.partitionBy("user_id"))
    dated = rows.withColumn("first_edit", first)
    return dated.where((F.col("first_edit") <= _latest_start(horizon, snapshot)) & (F.col("edit_date") <= F.date_add("first_edit", horizon))).drop("first_edit")


def window_rows(
    totals: DataFrame, times: DataFrame, horizon: int = HORIZON_DAYS, snapshot: str = rules.COHORT_SNAPSHOT, milestones: Sequence[int] = MILESTONES
) -> DataFrame:
    """The rows of ``prediction_summary`` from ``user_totals`` of the ``first_days`` and ``day_features`` up to the horizon."""
    base = _assembled(totals, times.where(F.col("first_edit") <= _latest_start(horizon, snapshot)), "last_in_window")
    return base.select(
        "user_id",
        "first_edit",
        "full_last_edit",
        _calendar(F.year).alias("first_edit_year"),
        "true_edit_days",
        *_pace_features(F.col("true_edit_days") / F.lit(float(horizon))),
        "pause_after_first_edit",
        _calendar(F.month).alias("first_edit_month"),
        *_country_features(),
        *_edit_type_features(),
        "total_edits",
        F.col("gap_stddev").alias("burstiness"),
        *_feature_type_features(),
        *_content_features(),
        F.col("active_weeks").alias("active_weeks_26"),
        *_milestone_features(milestones),
        X.ratio(F.col("true_edit_days"), F.col("active_duration") + 1).alias("activity_density"),
        _left_early(horizon),
    )


def categorization_summary(
    daily: DataFrame,
    horizon: int = HORIZON_DAYS,
    milestones: Sequence[int] = MILESTONES,
    early: Sequence[int] = EARLY_DAYS,
) -> DataFrame:
    """Feature row over each user's whole lifetime."""
    times = day_features(user_days(daily), None, milestones, early)
    return lifetime_rows(user_totals(user_country_sums(daily)), times, horizon, milestones)


def lifetime_rows(totals: DataFrame, times: DataFrame, horizon: int = HORIZON_DAYS, milestones: Sequence[int] = MILESTONES) -> DataFrame:
    """The rows of ``categorization_summary`` from ``user_totals`` and ``day_features`` of whole lifetimes."""
    base = _assembled(totals, times, "full_last_edit")
    span = F.col("active_duration") + 1
    weeks = X.weeks_between(F.col("first_edit"), F.col("full_last_edit")) + 1
    return base.select(
        "user_id",
        "first_edit",
        "full_last_edit",
        _calendar(F.year).alias("first_edit_year"),
        "true_edit_days",
        *_pace_features(X.ratio(F.col("true_edit_days"), F.col("active_duration"))),
        "pause_after_first_editing_day",
        "pause_after_first_edit",
        _calendar(F.month).alias("first_edit_month"),
        *_country_features(),
        *_edit_type_features(),
        "total_edits",
        burstiness_score(base).alias("burstiness_score"),
        *_feature_type_features(),
        *_content_features(),
        "active_weeks",
        X.ratio(F.col("active_weeks"), weeks).alias("active_week_ratio"),
        *_milestone_features(milestones),
        X.ratio(F.col("true_edit_days"), span).alias("activity_density"),
        X.ratio(F.col("total_edits"), span).alias("edits_per_span_day"),
        _left_early(horizon),
    )
