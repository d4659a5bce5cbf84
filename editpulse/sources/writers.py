"""Sinks of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_daily_activity(daily: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """One directory per country; only the countries in ``daily`` are replaced.

    Rows are rebalanced by country before writing: adaptive execution gathers small
    countries in few files and splits a country holding a third of the table over many
    tasks.
    """
    (
        daily.hint("rebalance", F.col("country"))
        .write.partitionBy("country")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_user_summary(summary: DataFrame, path: str) -> None:
    """Summary table ordered by user, zstd compressed.

    The global sort is a range shuffle, so it stays distributed; each file then covers
    its own user range, which makes later lookups by user skip files.
    """
    summary.orderBy("user_id").write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Small metric table (a model row, a k sweep, loadings) as one CSV file."""
    metrics.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def write_assignments(assigned: DataFrame, path: str) -> None:
    """Scaled features with the cluster label of every user."""
    assigned.write.option("compression", "zstd").mode("overwrite").parquet(path)
