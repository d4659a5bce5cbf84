"""The two table stages as commands: ``python -m editpulse daily …`` and ``python -m editpulse summaries …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from editpulse.plans import pipeline
from editpulse.sources import readers


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="editpulse", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)
    daily = stages.add_parser("daily", help="raw contributions to the daily table, one directory per country")
    daily.add_argument("contributions", help="Parquet files, folder or glob")
    daily.add_argument("boundaries", help="table of country boxes")
    daily.add_argument("output")
    daily.add_argument("--codes", nargs="+", help="country codes; all known ones by default, others at the output stay")
    daily.add_argument("--weighted-validity", action="store_true")
    daily.add_argument("--per-day-changesets", action="store_true")
    summaries = stages.add_parser("summaries", help="daily table to the two user summaries")
    summaries.add_argument("daily")
    summaries.add_argument("prediction")
    summaries.add_argument("categorization")
    summaries.add_argument("--horizon", type=int, default=180)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"editpulse-{given.stage}").getOrCreate()
    if given.stage == "daily":
        pipeline.build_daily_activity(
            readers.read_contributions(spark, given.contributions),
            readers.read_boundaries(spark, given.boundaries),
            given.output,
            codes=given.codes,
            weighted_validity=given.weighted_validity,
            per_day_changesets=given.per_day_changesets,
        )
    else:
        pipeline.build_user_summaries(spark, given.daily, given.prediction, given.categorization, horizon=given.horizon)


if __name__ == "__main__":
    main()
