"""From raw contributions to enriched contributions with a country label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpulse.functions import expressions as X
from editpulse.functions import rules
from editpulse.sources.staging import stage

BOX_FIELDS = ("xmin", "ymin", "xmax", "ymax")
BOX_TABLE = "country string, country_box struct<xmin: double, ymin: double, xmax: double, ymax: double>"
PSEUDO = (rules.STATELESS, rules.SPECIAL_REGIONS)


def box_table(spark: SparkSession, boxes: Sequence[tuple]) -> DataFrame:
    """Box table ``country, country_box`` from ``(iso, xmin, ymin, xmax, ymax)`` tuples."""
    return spark.createDataFrame([(code, tuple(map(float, bounds))) for code, *bounds in boxes], BOX_TABLE)


def country_boxes(boundaries: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """``country, country_box``: one bounding box per country code, written once.

    A country may consist of several parts; its box spans all of them.  The two pseudo
    countries get the whole world.  Unknown codes raise ``ValueError``.
    """
    spark = boundaries.sparkSession
    wanted = None if codes is None else list(dict.fromkeys(code.upper() for code in codes))
    parts = boundaries.where((F.length("iso") > 1) & ~F.col("iso").isin(*PSEUDO))
    if wanted is not None:
        parts = parts.where(F.col("iso").isin(*wanted))
    bounds = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    spanned = parts.groupBy("iso").agg(*bounds).select(F.col("iso").alias("country"), F.struct(*BOX_FIELDS).alias("country_box"))
    world = [(code, *rules.WORLD_BOUNDS) for code in PSEUDO if wanted is None or code in wanted]
    boxes = stage(spanned.unionByName(box_table(spark, world)), "country-boxes")
    if wanted is not None:
        known = {row["country"] for row in boxes.select("country").collect()}  # at most the wanted codes
        unknown = sorted(set(wanted) - known)
        if unknown:
            raise ValueError(f"no boundary for country codes {unknown}")
    return boxes


def in_time_range(contributions: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open range on the start of validity."""
    moment = F.col("valid_from")
    return contributions.where((moment >= X.timestamp(start)) & (moment < X.timestamp(end)))


def country_contributions(
    contributions: DataFrame,
    box: tuple,
    start: str = rules.RANGE_START,
    end: str = rules.RANGE_END,
) -> DataFrame:
    """Contributions of one country: membership, box containment and time range."""
    code, *bounds = box
    limits = F.struct(*(F.lit(v).alias(n) for n, v in zip(BOX_FIELDS, bounds)))
    rows = in_time_range(contributions, start, end).where(X.country_member(code))
    return rows.where(X.inside_box(F.col("bbox"), limits)).withColumn("country", F.lit(code))


def _labels() -> Column:
    """All labels of a row, each once; NULL country lists carry none."""
    own = F.array_except("countries", F.array(*map(F.lit, PSEUDO)))
    groups = [
        F.when(X.country_member(code), F.array(F.lit(code))).otherwise(F.expr("cast(array() AS array<string>)")) for code in PSEUDO
    ]
    return F.concat(own, *groups)


def assign_countries(
    contributions: DataFrame,
    boxes: DataFrame,
    start: str = rules.RANGE_START,
    end: str = rules.RANGE_END,
) -> DataFrame:
    """Label contributions with every country in ``boxes`` in one scan.

    A contribution listed for n countries yields up to n rows, one per country whose box
    holds it.  The time range and the envelope of all boxes reach the Parquet scan as
    filters.  Labels are exploded first and the join drops those without a box; the box
    table is a written or local one, so Spark knows its size and broadcasts it while small.
    """
    field = lambda name: F.col("country_box")[name]
    envelope = boxes.agg(
        F.min(field("xmin")).alias("xmin"), F.min(field("ymin")).alias("ymin"), F.max(field("xmax")).alias("xmax"), F.max(field("ymax")).alias("ymax")
    ).first()
    limits = F.struct(*(F.lit(envelope[name]).alias(name) for name in BOX_FIELDS))
    rows = in_time_range(contributions, start, end).where(X.inside_box(F.col("bbox"), limits))
    labelled = rows.withColumn("country", F.explode(_labels()))
    return labelled.join(boxes, "country").where(X.inside_box(F.col("bbox"), F.col("country_box"))).drop("country_box")


def enrich(contributions: DataFrame, snapshot: str = rules.VALIDITY_SNAPSHOT) -> DataFrame:
    """Derived columns of every contribution.

    Durations are whole microseconds.  A missing end of validity means still valid, so
    it is clamped to the snapshot.
    """
    change = F.col("changeset")
    passed_on = [F.col(c) for c in ("country",) if c in contributions.columns]
    base = contributions.select(
        F.col("countries").alias("country_iso_a3"),
        "osm_id",
        F.col("user.id").alias("user_id"),
        "valid_from",
        "valid_to",
        F.to_date("valid_from").alias("edit_date"),
        "contrib_type",
        F.map_keys("tags").alias("tag_keys"),
        X.keys_only_in("tags", "tags_before").alias("new_keys"),
        X.keys_only_in("tags_before", "tags").alias("removed_keys"),
        X.categories_only_in("tags", "tags_before", rules.ADDED_KEY_CATEGORIES).alias("new_feature_categories"),
        X.categories_only_in("tags_before", "tags", rules.REMOVED_KEY_CATEGORIES).alias("removed_feature_categories"),
        "tags",
        "tags_before",
        change["id"].alias("changeset_id"),
        change["editor"].alias("editor"),
        F.length(change["tags"]["comment"]).alias("length_comment"),
        X.micros_between(change["created_at"], change["closed_at"]).alias("changeset_edit_duration"),
        X.editor_category("changeset.editor").alias("editor_category"),
        X.micros_between(F.col("valid_from"), F.least("valid_to", X.timestamp(snapshot))).alias("validity_duration"),
        "osm_type",
        *(flag.alias(name) for name, flag in X.feature_flags("tags").items()),
        *passed_on,
    )
    # Every changed key has exactly one category, so counting categories counts keys; the
    # rollup then never has to build the key lists.
    return base.withColumns(
        {
            "length_new_keys": F.size("new_feature_categories"),
            "length_removed_keys": F.size("removed_feature_categories"),
        }
    )
