"""DuckDB parts for the user summaries."""

from __future__ import annotations

from checks.oracle_views import SNAPSHOT_DATE, add_part
from editpulse.functions import rules
from editpulse.operators.summary import TOTALS


def _window_parts(source: str, prefix: str, horizon: int | None) -> None:
    """Parts ``<prefix>rows``, ``<prefix>country``, ``<prefix>spread``, ``<prefix>seq`` and ``<prefix>times``."""
    having = "" if horizon is None else f"HAVING min(edit_date) + {horizon} <= DATE '{SNAPSHOT_DATE}'"
    inside = "TRUE" if horizon is None else f"edit_date - first_edit <= {horizon}"
    p = prefix
    add_part(
        f"{p}rows",
        (source,),
        f"""
{p}cohort AS (
  SELECT user_id, min(edit_date) AS first_edit, max(edit_date) AS full_last_edit
  FROM {source} GROUP BY user_id {having}
),
{p}rows AS (SELECT * FROM {source} JOIN {p}cohort USING (user_id) WHERE {inside})""",
    )
    add_part(
        f"{p}spread",
        (f"{p}rows",),
        f"""
{p}country AS (
  SELECT user_id, country, sum(edit_count) AS edits, min(edit_date) AS min_date, max(edit_date) AS max_date,
         count(DISTINCT edit_date) AS days_editing_country
  FROM {p}rows GROUP BY ALL
),
{p}shares AS (SELECT *, edits / sum(edits) OVER (PARTITION BY user_id) AS share FROM {p}country),
{p}spread AS (
  SELECT user_id, count(*) AS number_of_countries, max(edits) AS max_country_edits,
         round(abs(sum(share * log2(share))), 4) AS entropy_country_distribution,
         first(country ORDER BY edits DESC, country) AS top_country
  FROM {p}shares GROUP BY user_id
)""",
    )
    add_part(
        f"{p}times",
        (f"{p}rows",),
        f"""
{p}days AS (
  SELECT user_id, edit_date, any_value(first_edit) AS first_edit, any_value(full_last_edit) AS full_last_edit,
         sum(edit_count) AS edits, count(*) AS places
  FROM {p}rows GROUP BY user_id, edit_date
),
{p}seq AS (
  SELECT *, edit_date - lag(edit_date) OVER w AS gap, row_number() OVER w AS nth,
         sum(edits) OVER w AS so_far, edit_date - first_edit AS age
  FROM {p}days WINDOW w AS (PARTITION BY user_id ORDER BY edit_date)
),
{p}times AS (
  SELECT user_id, any_value(first_edit) AS first_edit, any_value(full_last_edit) AS full_last_edit,
         max(edit_date) AS last_in_window, count(*) AS true_edit_days,
         stddev_samp(gap) AS gap_stddev, avg(gap) AS gap_mean,
         count(DISTINCT date_trunc('week', edit_date)) AS active_weeks,
         max(gap) FILTER (nth = 2) AS pause_after_first_editing_day,
         CASE WHEN max(places) FILTER (nth = 1) > 1 THEN 0 ELSE max(gap) FILTER (nth = 2) END
           AS pause_after_first_edit,
         min(age) FILTER (so_far >= 50) AS days_to_50, min(age) FILTER (so_far >= 100) AS days_to_100,
         coalesce(sum(edits) FILTER (age <= 7), 0) / nullif(sum(edits) FILTER (age <= 30), 0)::DOUBLE
           AS frontload_ratio,
         count(*) FILTER (age <= 7) / nullif(count(*) FILTER (age <= 30), 0)::DOUBLE AS early_days_ratio
  FROM {p}seq GROUP BY user_id
)""",
    )


_window_parts("activity", "life_", None)
_window_parts("activity", "win_", 180)
_window_parts("daily", "cat_", None)
_window_parts("daily", "pred_", 180)

WEEK_SPAN = (
    "(date_trunc('week', full_last_edit)::DATE - date_trunc('week', first_edit)::DATE) // 7 + 1"
)


def top_feature_sql() -> str:
    values = ", ".join(f"{{'name': '{f}', 'n': total_{f}}}" for f in rules.FEATURES)
    top = ", ".join(f"total_{f}" for f in rules.FEATURES)
    return (
        f"CASE WHEN greatest({top}) = 0 THEN 'none' ELSE "
        f"list_filter([{values}], lambda s: s.n = greatest({top}))[1].name END"
    )


def totals_sql(rows: str) -> str:
    sums = ", ".join(f"sum({source}) AS {name}" for source, name in TOTALS.items())
    return f"SELECT user_id, {sums} FROM {rows} GROUP BY user_id"


def breadth_sql() -> str:
    return (
        f"{' + '.join(f'(total_{f} > 0)::INT' for f in rules.FEATURES)} AS feature_category_count, "
        f"greatest({', '.join(f'total_{f}' for f in rules.FEATURES)})::DOUBLE AS largest, "
        f"({' + '.join(f'total_{f}' for f in rules.FEATURES)}) AS summed, {top_feature_sql()} AS top_feature_type_name"
    )


SHARES = {
    "created_ratio": "total_created",
    "deleted_ratio": "total_deleted",
    "tag_ratio": "total_tagged",
    "geometry_ratio": "total_geometry",
    "none_ratio": "total_none",
    **{f"{feature}_ratio": f"total_{feature}" for feature in rules.FEATURES},
    "node_ratio": "total_nodes",
    "way_ratio": "total_ways",
    "relation_ratio": "total_relations",
    "geometry_tag_ratio": "total_geometry_tag",
    "new_keys_ratio": "total_new_keys",
    "deleted_keys_ratio": "total_deleted_keys",
    "avg_days_valid_per_edit": "total_days_valid",
}
PER_CHANGESET = {
    "edits_per_changeset_ratio": "total_edits",
    "changeset_duration_ratio_in_sec": "total_changeset_duration_in_sec",
    **{f"{name}_changeset_ratio": f"total_{name}_changesets" for name in rules.EDITOR_COLUMNS.values()},
    "comment_length_ratio": "total_comment_length",
}


def summary_sql(prefix: str) -> str:
    """Every feature of either summary; the caller picks its columns."""
    days = "true_edit_days"
    shares = ", ".join(f"{total}::DOUBLE / nullif(total_edits, 0) AS {name}" for name, total in SHARES.items())
    per_set = ", ".join(f"{total}::DOUBLE / nullif(total_changesets, 0) AS {name}" for name, total in PER_CHANGESET.items())
    return f"""
SELECT *, year(first_edit) AS first_edit_year, month(first_edit) AS first_edit_month,
  last_in_window - first_edit AS active_duration,
  {days} / 180.0 AS days_per_horizon, {days}::DOUBLE / nullif(full_last_edit - first_edit, 0) AS days_per_span,
  total_edits::DOUBLE / {days} AS edits_per_day_true,
  (last_in_window - first_edit)::DOUBLE / nullif({days} - 1, 0) AS mean_days_between_edits_true,
  max_country_edits::DOUBLE / total_edits AS top_country_ratio,
  (1 - max_country_edits::DOUBLE / total_edits) * ln(total_edits + 1) / ln(10) AS diversity_score,
  gap_stddev AS burstiness, (gap_stddev - gap_mean) / nullif(gap_stddev + gap_mean, 0) AS burstiness_score,
  {shares}, {per_set},
  largest / nullif(summed, 0) AS top_feature_ratio,
  (total_new_keys + total_deleted_keys)::DOUBLE / nullif(total_changesets, 0) AS keys_per_changeset_ratio,
  total_changesets::DOUBLE / {days} AS changesets_per_edit_day,
  active_weeks AS active_weeks_26, active_weeks::DOUBLE / ({WEEK_SPAN}) AS active_week_ratio,
  {days}::DOUBLE / (last_in_window - first_edit + 1) AS activity_density,
  total_edits::DOUBLE / (full_last_edit - first_edit + 1) AS edits_per_span_day,
  full_last_edit - first_edit < 180 AS left_early
FROM {prefix}times JOIN {prefix}spread USING (user_id)
JOIN (SELECT *, {breadth_sql()} FROM ({totals_sql(prefix + "rows")})) USING (user_id)"""


add_part("prediction", ("pred_times", "pred_spread"), f"\nprediction AS (SELECT *, days_per_horizon AS activity_ratio_true FROM ({summary_sql('pred_')}))")
add_part("categorization", ("cat_times", "cat_spread"), f"\ncategorization AS (SELECT *, days_per_span AS activity_ratio_true FROM ({summary_sql('cat_')}))")
