"""Readers for the tables of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpulse.sources.wkb import envelopes

CONTRIBUTION_SCHEMA = """
    countries array<string>, osm_id bigint, osm_type string, user struct<id: bigint>,
    valid_from timestamp_ntz, valid_to timestamp_ntz,
    tags map<string, string>, tags_before map<string, string>, contrib_type string,
    changeset struct<id: bigint, editor: string, tags: map<string, string>,
                     created_at: timestamp_ntz, closed_at: timestamp_ntz>,
    bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>
"""


def read_contributions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw contributions from Parquet files or globs, read with an explicit schema.

    The explicit schema avoids a footer scan over all files, and together with nested
    column pruning only the struct fields a query touches are decoded.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(CONTRIBUTION_SCHEMA).option("mergeSchema", "false").parquet(*paths)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Country parts as bounding boxes ``iso, xmin, ymin, xmax, ymax``, stored as such or as well-known binary in ``geometry``."""
    stored = spark.read.parquet(path)
    if "xmin" not in stored.columns:
        stored = envelopes(stored.select("iso", "geometry"))
    return stored.select("iso", *(F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")))


def read_daily_activity(spark: SparkSession, path: str) -> DataFrame:
    """Daily activity table, partitioned by country."""
    return spark.read.parquet(path)


def read_user_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
