"""Whole-stage jobs: raw contributions to the daily table, daily table to summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from editpulse.functions import rules
from editpulse.operators.daily import daily_inputs, daily_user_activity
from editpulse.operators.enrich import assign_countries, country_boxes, enrich
from editpulse.operators.summary import categorization_summary, prediction_summary
from editpulse.sources.readers import read_daily_activity
from editpulse.sources.staging import job_tables, stage
from editpulse.sources.writers import write_daily_activity, write_user_summary


def daily_activity(
    contributions: DataFrame,
    boundaries: DataFrame,
    codes: Sequence[str] | None = None,
    start: str = rules.RANGE_START,
    end: str = rules.RANGE_END,
    validity_snapshot: str = rules.VALIDITY_SNAPSHOT,
    per_day_changesets: bool = False,
    weighted_validity: bool = False,
) -> DataFrame:
    """Daily table of all requested countries (all known ones by default).

    One scan of the raw data labels, enriches and narrows the contributions; the narrow
    rows are written once and the rollup reads those.
    """
    boxes = country_boxes(boundaries, codes)
    enriched = enrich(assign_countries(contributions, boxes, start, end), validity_snapshot)
    return daily_user_activity(stage(daily_inputs(enriched), "daily-inputs"), per_day_changesets, weighted_validity)


def build_daily_activity(contributions: DataFrame, boundaries: DataFrame, path: str, **options) -> None:
    """Writes the daily table of the requested countries; other countries at ``path`` stay."""
    with job_tables(contributions.sparkSession):
        write_daily_activity(daily_activity(contributions, boundaries, **options), path)


def build_user_summaries(
    spark: SparkSession,
    daily_path: str,
    prediction_path: str,
    categorization_path: str,
    snapshot: str = rules.COHORT_SNAPSHOT,
    **shared,
) -> None:
    """Both summary tables from the daily table on disk.

    ``snapshot`` limits the cohort of the first table; all other options (horizon, milestones, early)
    hold for both.
    """
    daily = read_daily_activity(spark, daily_path)
    with job_tables(spark):
        write_user_summary(prediction_summary(daily, snapshot=snapshot, **shared), prediction_path)
        write_user_summary(categorization_summary(daily, **shared), categorization_path)
