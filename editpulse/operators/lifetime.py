"""User summaries straight from contributions, without the daily table.

A summary needs no wide daily rows: its totals are sums over contributions, and only distinct days,
changesets and validity intervals need more; its first days are a window over the rows of a user.  Contributions of a user are gathered once per question as
narrow rows, and every group below lies inside a user, so nothing is shuffled again.  Users with more
than ``GATHERED_ROWS`` contributions are left to the daily table, whose aggregates are combined before
each shuffle; so no task holds more of one user than that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.functions import expressions as X
from editpulse.functions import rules
from editpulse.operators import daily as D
from editpulse.operators import summary as U
from editpulse.sources.staging import stage

#: Contributions of one user that a task may gather.
GATHERED_ROWS = D.GATHERED_ROWS

Rows = Callable[[DataFrame], DataFrame]


def _all(rows: DataFrame) -> DataFrame:
    return rows


def lifetime_inputs(enriched: DataFrame) -> DataFrame:
    """``daily_inputs`` with the number of changed keys alone; their categories are no part of a summary."""
    counted = enriched.withColumns(
        {
            "length_new_keys": F.size(X.keys_only_in("tags", "tags_before")),
            "length_removed_keys": F.size(X.keys_only_in("tags_before", "tags")),
        }
    )
    return D.daily_inputs(counted, categories=False)


def content_totals(gathered: DataFrame, kept: Rows = _all) -> DataFrame:
    """Totals of edits, object types, features, changed keys and days of validity per user, over the days that are ``kept``."""
    cells = kept(D.fine_counts(gathered, F.sum("length_new_keys").alias("new_keys"), F.sum("length_removed_keys").alias("removed_keys")))
    names = {D.TYPE_COLUMNS[kind]: f"type_code = {code}" for kind, code in D._TYPE_CODES.items()}
    names |= {D.OBJECT_COLUMNS[kind]: f"object_code = {code}" for kind, code in D._OBJECT_CODES.items()}
    names |= {D.FEATURE_COLUMNS[feature]: f"(shiftright(flag_code, {2 * place}) & 3) = 1" for place, feature in enumerate(rules.FEATURES)}
    return cells.groupBy("user_id").agg(
        F.sum("contrib_count").alias("total_edits"),
        *(D._sum_if(condition, "contrib_count", U.TOTALS[column]) for column, condition in names.items()),
        F.sum("new_keys").alias("total_new_keys"),
        F.sum("removed_keys").alias("total_deleted_keys"),
        F.expr(f"sum(cast(validity_duration AS double)) / {D.MICROS_PER_DAY}D AS total_days_valid"),
    )


def changeset_totals(gathered: DataFrame, kept: Rows = _all) -> DataFrame:
    """Totals of changesets, editors, comments and durations per user, over the days that are ``kept``.

    Days are chosen when changesets are whole, as edits on other days count on each of their days.
    """
    days = kept(D.changeset_days(gathered, gathered=True))
    columns = (
        D._sum_if(f"editor_rank = {D._EDITOR_LABELS.index(label) + 1}", "changesets", f"total_{name}_changesets")
        for label, name in rules.EDITOR_COLUMNS.items()
    )
    # a day without a whole key has no statistics
    return days.dropna(subset=list(D.DAY_KEY)).groupBy("user_id").agg(
        F.sum("changesets").alias("total_changesets"),
        F.expr("sum(cast(duration_micros AS double)) / 1e6D AS total_changeset_duration_in_sec"),
        F.sum("comment_length").alias("total_comment_length"),
        *columns,
    )


def edit_days(gathered: DataFrame) -> DataFrame:
    return gathered.groupBy(*D.DAY_KEY).agg(F.count(F.lit(1)).alias("edit_count"))


def gathered_totals(gathered: DataFrame, kept: Rows = _all) -> DataFrame:
    """``user_totals`` over the days that are ``kept``, of users whose contributions one task can hold."""
    places = U.user_totals(U.user_country_sums(kept(edit_days(gathered)), ["edit_count"])).drop("total_edits")
    return places.join(content_totals(gathered, kept), "user_id").join(changeset_totals(gathered, kept), "user_id", "left")


def _summary(rows: DataFrame, from_gathered: Rows, from_daily: Rows, unknown: bool = False) -> DataFrame:
    """The rows of all known users: of heavy ones from their daily table, of others from their gathered contributions.

    With ``unknown`` the rows without a user make one more, from their daily table.
    """
    light, heavy = D.split_heavy(rows.where(F.col("user_id").isNotNull()), GATHERED_ROWS)
    apart = [frame for frame in (heavy, rows.where(F.col("user_id").isNull()) if unknown else None) if frame is not None and not frame.isEmpty()]
    found = from_gathered(D.gathered(light))
    unread = F.lit("")  # the daily columns that count categories are not selected
    for active in apart:
        daily = D.daily_user_activity(active.withColumns({"new_feature_categories": unread, "removed_feature_categories": unread}))
        found = found.unionByName(from_daily(stage(daily.select(*D.DAY_KEY, *U.TOTALS), "daily")))
    return found


def prediction_summary(
    rows: DataFrame,
    horizon: int = U.HORIZON_DAYS,
    snapshot: str = rules.COHORT_SNAPSHOT,
    milestones: Sequence[int] = U.MILESTONES,
    early: Sequence[int] = U.EARLY_DAYS,
) -> DataFrame:
    """The rows of ``summary.prediction_summary`` from staged ``lifetime_inputs``."""

    def from_gathered(gathered: DataFrame) -> DataFrame:
        times = U.day_features(U.user_days(edit_days(gathered)), horizon, milestones, early)
        totals = gathered_totals(gathered, lambda days: U.first_days(days, horizon, snapshot))
        return U.window_rows(totals, times, horizon, snapshot, milestones)

    return _summary(rows, from_gathered, lambda daily: U.prediction_summary(daily, horizon, snapshot, milestones, early))


def categorization_summary(
    rows: DataFrame,
    horizon: int = U.HORIZON_DAYS,
    milestones: Sequence[int] = U.MILESTONES,
    early: Sequence[int] = U.EARLY_DAYS,
) -> DataFrame:
    """The rows of ``summary.categorization_summary`` from staged ``lifetime_inputs``."""

    def from_gathered(gathered: DataFrame) -> DataFrame:
        times = U.day_features(U.user_days(edit_days(gathered)), None, milestones, early)
        return U.lifetime_rows(gathered_totals(gathered), times, horizon, milestones)

    return _summary(rows, from_gathered, lambda daily: U.categorization_summary(daily, horizon, milestones, early))


def user_totals(rows: DataFrame) -> DataFrame:
    """The rows of ``summary.user_totals`` over whole lifetimes, without their days, from staged ``lifetime_inputs``."""
    return _summary(rows, gathered_totals, lambda daily: U.user_totals(U.user_country_sums(daily)), unknown=True)
