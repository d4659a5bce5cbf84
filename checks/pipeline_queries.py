"""Registered queries for the enrichment, daily and summary stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import contribution_view as view
from checks import oracle_summary as S
from checks.oracle_views import EDITOR_SQL, SPECIAL, VALID_MICROS, with_parts
from checks.shapes import Shape, shape, shaped, shaped_sql
from editpulse.functions import expressions as X
from editpulse.functions import rules
from editpulse.operators import daily as D
from editpulse.operators import enrich as E
from editpulse.operators import lifetime as T
from editpulse.operators import summary as U
from editpulse.sources.readers import read_boundaries, read_daily_activity
from editpulse.sources.staging import stage, staging_root
from editpulse.sources.writers import write_daily_activity


@dataclass(frozen=True)
class Query:
    columns: Shape
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(self.build(spark, sf_dir), self.columns)


QUERIES: dict[str, Query] = {}


def register(columns: Shape, sql: str | None = None, with_clause: str = ""):
    """Register the decorated builder under its function name."""

    def add(build):
        statement = None if sql is None else shaped_sql(sql, columns, with_clause)
        QUERIES[build.__name__] = Query(columns, build, statement)
        return build

    return add


# ------------------------------------------------------------------ shared inputs
def assigned(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    boxes = E.country_boxes(view.boundaries(spark, sf_dir))
    return E.assign_countries(view.contributions(spark, sf_dir, profile), boxes, view.RANGE_START, view.RANGE_END)


def enriched(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    return E.enrich(assigned(spark, sf_dir, profile), view.VALIDITY_SNAPSHOT)


def activity(spark: SparkSession, sf_dir: str, profile: str = "medium") -> DataFrame:
    """Daily rows with the edit count only."""
    return enriched(spark, sf_dir, profile).groupBy(*D.DAY_KEY).agg(F.count(F.lit(1)).alias("edit_count"))


def staged_inputs(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    return stage(D.daily_inputs(enriched(spark, sf_dir, profile)), "daily-inputs")


def staged_daily(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    """The daily table as written between the two stages, with the columns the summaries read."""
    daily = D.daily_user_activity(staged_inputs(spark, sf_dir, profile))
    return stage(daily.select(*D.DAY_KEY, *U.TOTALS), "daily")


def lifetime_inputs(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    return stage(T.lifetime_inputs(enriched(spark, sf_dir, profile)), "lifetime-inputs")


def prediction(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    return T.prediction_summary(lifetime_inputs(spark, sf_dir, profile), snapshot=view.COHORT_SNAPSHOT)


def categorization(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    return T.categorization_summary(lifetime_inputs(spark, sf_dir, profile))


# ------------------------------------------------------------------ filters and enrichment
LOG_KEY = "osm_id changeset_id user_id"


def _log_rows(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("changeset.id").alias("changeset_id"), F.col("user.id").alias("user_id"))


def _filter_query(name: str, code: str, condition: str) -> None:
    def build(spark, sf_dir):
        rows = E.in_time_range(view.contributions(spark, sf_dir), view.RANGE_START, view.RANGE_END)
        return _log_rows(rows.where(X.country_member(code)))

    build.__name__ = name
    register(
        shape(int=LOG_KEY, str="contrib_type", list="countries"),
        f"SELECT * FROM log WHERE {condition} AND valid_from >= TIMESTAMP '{view.RANGE_START}' "
        f"AND valid_from < TIMESTAMP '{view.RANGE_END}'",
        with_parts("sparse", "log"),
    )(build)


_filter_query("country_filter", "N03", "list_contains(countries, 'N03')")
_filter_query("stateless_filter", rules.STATELESS, "len(countries) = 0")
_filter_query("special_region_filter", rules.SPECIAL_REGIONS, SPECIAL)


@register(
    shape(int=LOG_KEY, str="country contrib_type", day="edit_date"),
    "SELECT * FROM assigned",
    with_parts("sparse", "assigned"),
)
def bbox_country_assignment(spark, sf_dir):
    return _log_rows(assigned(spark, sf_dir)).withColumn("edit_date", F.to_date("valid_from"))


@register(
    shape(int=f"{LOG_KEY} length_new_keys length_removed_keys", str="country", list="tag_keys new_keys removed_keys"),
    "SELECT *, map_keys(tags) AS tag_keys, len(new_keys) AS length_new_keys, "
    "len(removed_keys) AS length_removed_keys FROM enriched",
    with_parts("sparse", "enriched"),
)
def key_diff(spark, sf_dir):
    return enriched(spark, sf_dir)


def _category_query(name: str, column: str, array: str) -> None:
    def build(spark, sf_dir):
        exploded = enriched(spark, sf_dir).select("country", F.explode(column).alias("category"))
        return exploded.groupBy("country", "category").agg(F.count(F.lit(1)).alias("n_keys"))

    build.__name__ = name
    register(
        shape(str="country category", int="n_keys"),
        f"SELECT country, category, count(*) AS n_keys FROM (SELECT country, unnest({array}) AS category FROM enriched) GROUP BY ALL",
        with_parts("sparse", "enriched"),
    )(build)


_category_query("added_key_categories", "new_feature_categories", "added")
_category_query("removed_key_categories", "removed_feature_categories", "removed")


@register(
    shape(int=LOG_KEY, str="country", bool=" ".join(rules.FEATURES)),
    "SELECT * FROM enriched",
    with_parts("sparse", "enriched"),
)
def feature_flags(spark, sf_dir):
    return enriched(spark, sf_dir)


@register(
    shape(str="editor editor_category", int="n_rows"),
    f"SELECT editor, {EDITOR_SQL} AS editor_category, count(*) AS n_rows FROM assigned GROUP BY ALL",
    with_parts("sparse", "assigned"),
)
def editor_category(spark, sf_dir):
    return enriched(spark, sf_dir).groupBy("editor", "editor_category").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    shape(int=f"{LOG_KEY} length_comment changeset_edit_duration", str="country"),
    "SELECT *, duration_micros AS changeset_edit_duration FROM enriched",
    with_parts("sparse", "enriched"),
)
def changeset_metrics(spark, sf_dir):
    return enriched(spark, sf_dir)


@register(
    shape(int=LOG_KEY, str="country", num="days_valid"),
    f"SELECT *, ({VALID_MICROS})::DOUBLE / 86400000000 AS days_valid FROM assigned",
    with_parts("sparse", "assigned"),
)
def validity_days(spark, sf_dir):
    return enriched(spark, sf_dir).withColumn("days_valid", F.col("validity_duration") / D.MICROS_PER_DAY)


# ------------------------------------------------------------------ daily rollup
DAY_SHAPE = shape(int="user_id", str="country", day="edit_date")


def _numbered(names, doubles=()) -> Shape:
    return {name: ("num" if name in doubles else "int") for name in names}


_DOUBLES = {"total_days_valid", "avg_edits_per_changeset_per_day", "total_changeset_duration_per_day_in_sec"}
_CORE = [name for name in D.CORE_COLUMNS if name not in D.MATRIX_COLUMNS.values()]


@register(DAY_SHAPE | _numbered(_CORE, _DOUBLES), "SELECT * FROM core", with_parts("sparse", "core"))
def daily_core_counts(spark, sf_dir):
    return D.daily_core(staged_inputs(spark, sf_dir))


@register(
    DAY_SHAPE | _numbered(D.MATRIX_COLUMNS.values()), "SELECT * FROM core", with_parts("dense", "core")
)
def daily_feature_type_matrix(spark, sf_dir):
    return D.daily_core(staged_inputs(spark, sf_dir, "dense"))


@register(
    DAY_SHAPE | _numbered(D.CHANGESET_COLUMNS, _DOUBLES), "SELECT * FROM changesets", with_parts("sparse", "changesets")
)
def daily_changeset_stats(spark, sf_dir):
    return D.daily_changesets(enriched(spark, sf_dir))


def _tag_change_query(name: str, columns) -> None:
    def build(spark, sf_dir):
        return D.daily_tag_changes(enriched(spark, sf_dir))

    build.__name__ = name
    register(DAY_SHAPE | _numbered(columns), "SELECT * FROM tag_changes", with_parts("sparse", "tag_changes"))(build)


_tag_change_query("daily_key_changes", D.KEY_COLUMNS)
_tag_change_query("daily_added_categories", D.ADDED_COLUMNS.values())
_tag_change_query("daily_removed_categories", D.REMOVED_COLUMNS.values())


@register(
    DAY_SHAPE | _numbered([c for c in D.DAILY_COLUMNS if c not in D.DAY_KEY], _DOUBLES),
    "SELECT * FROM daily",
    with_parts("sparse", "daily"),
)
def daily_user_activity(spark, sf_dir):
    return D.daily_user_activity(staged_inputs(spark, sf_dir))


# ------------------------------------------------------------------ user operators
USER = shape(int="user_id")


@register(USER | shape(day="first_edit full_last_edit"), "SELECT * FROM life_cohort", with_parts("sparse", "life_rows"))
def first_last_activity(spark, sf_dir):
    return U.first_last_activity(activity(spark, sf_dir, "sparse"))


@register(USER | shape(day="first_edit full_last_edit"), "SELECT * FROM win_cohort", with_parts("sparse", "win_rows"))
def eligible_cohort(spark, sf_dir):
    return U.eligible_cohort(activity(spark, sf_dir, "sparse"), view.COHORT_SNAPSHOT)


@register(DAY_SHAPE | shape(int="edit_count"), "SELECT * FROM win_rows", with_parts("sparse", "win_rows"))
def observation_window(spark, sf_dir):
    rows = activity(spark, sf_dir, "sparse")
    return U.observation_window(rows, U.eligible_cohort(rows, view.COHORT_SNAPSHOT))


_TOTAL_SHAPE = {name: ("num" if name in ("total_days_valid", "total_changeset_duration_in_sec") else "int") for name in U.TOTALS.values()}


@register(
    USER | shape(str="country", day="min_date max_date", int="days_editing_country") | _TOTAL_SHAPE,
    "SELECT user_id, country, min(edit_date) AS min_date, max(edit_date) AS max_date, "
    "count(DISTINCT edit_date) AS days_editing_country, "
    + ", ".join(f"sum({source}) AS {name}" for source, name in U.TOTALS.items())
    + " FROM daily GROUP BY user_id, country",
    with_parts("medium", "daily"),
)
def user_country_sums(spark, sf_dir):
    rows = staged_daily(spark, sf_dir, "medium")
    return U.user_country_sums(rows).join(U.days_per_country(rows), ["user_id", "country"])


@register(
    USER | _TOTAL_SHAPE | shape(int="number_of_countries max_country_edits"),
    f"SELECT * FROM ({S.totals_sql('cat_rows')}) JOIN cat_spread USING (user_id)",
    with_parts("medium", "cat_spread"),
)
def user_totals(spark, sf_dir):
    return T.user_totals(lifetime_inputs(spark, sf_dir, "medium"))


def _times_query(name: str, columns: Shape, profile: str = "medium", sql: str = "SELECT * FROM life_times", extra=None) -> None:
    def build(spark, sf_dir):
        features = U.day_features(U.user_days(activity(spark, sf_dir, profile)))
        return features if extra is None else extra(features)

    build.__name__ = name
    register(USER | columns, sql, with_parts(profile, "life_times"))(build)


_times_query("true_edit_days", shape(int="true_edit_days"))
_times_query("gap_stddev", shape(num="gap_stddev gap_mean"))
_times_query(
    "burstiness_score",
    shape(num="burstiness_score"),
    sql="SELECT *, (gap_stddev - gap_mean) / nullif(gap_stddev + gap_mean, 0) AS burstiness_score FROM life_times",
    extra=lambda f: f.withColumn("burstiness_score", U.burstiness_score(f)),
)
_times_query(
    "active_weeks",
    shape(int="active_weeks total_weeks", num="active_week_ratio"),
    sql=f"SELECT *, {S.WEEK_SPAN} AS total_weeks, active_weeks::DOUBLE / ({S.WEEK_SPAN}) AS active_week_ratio FROM life_times",
    extra=lambda f: f.withColumn("total_weeks", X.weeks_between(F.col("first_edit"), F.col("full_last_edit")) + 1).withColumn(
        "active_week_ratio", X.ratio(F.col("active_weeks"), F.col("total_weeks"))
    ),
)
_times_query("milestones_50", shape(int="days_to_50"))
_times_query("milestones_100", shape(int="days_to_100"), profile="dense")
_times_query(
    "early_window_ratios",
    shape(num="frontload_ratio early_days_ratio"),
    extra=lambda f: f.select(
        "user_id",
        X.ratio(F.col("early_edits_short"), F.col("early_edits_long")).alias("frontload_ratio"),
        X.ratio(F.col("early_days_short"), F.col("early_days_long")).alias("early_days_ratio"),
    ),
)
_times_query("pause_after_first_edit", shape(int="pause_after_first_edit"), profile="sparse")
_times_query("pause_after_first_day", shape(int="pause_after_first_editing_day"), profile="sparse")
_times_query("observed_span", shape(day="first_edit last_in_window"), profile="sparse")


@register(DAY_SHAPE, "SELECT DISTINCT user_id, country, edit_date FROM enriched", with_parts("medium", "enriched"))
def distinct_days(spark, sf_dir):
    return enriched(spark, sf_dir, "medium").select("user_id", "country", "edit_date").distinct()


@register(
    DAY_SHAPE | shape(int="edit_count"),
    "SELECT user_id, country, edit_date, edit_count FROM activity",
    with_parts("medium", "activity"),
)
def daily_table_on_disk(spark, sf_dir):
    """Written by country in two goes, the second of which leaves the first one's countries, and read again."""
    days = stage(activity(spark, sf_dir), "activity")
    path = f"{staging_root(spark)}/editpulse-countries-{uuid.uuid4().hex}"
    for half in (0, 1):
        write_daily_activity(days.where(F.pmod(F.crc32("country"), F.lit(2)) == half), path)
    return read_daily_activity(spark, path)


def _two_parts(sides: dict[str, str], order: str) -> str:
    """SQL for the well-known binary of a box, cut in the middle into a multi-polygon of two parts.

    Numbers are taken from the hexadecimal form of their bits: all sides are whole or half and below 1024,
    so a double is a sign, an exponent and few leading bits, which ``bits`` puts together.
    """
    corners = lambda a, b: [(a, "ymin"), (b, "ymin"), (b, "ymax"), (a, "ymax"), (a, "ymin")]
    whole = lambda n: f"{n:08x}" if order == "00" else n.to_bytes(4, "little").hex()
    double = lambda side: sides[side] if order == "00" else " || ".join(f"substring({sides[side]}, {k}, 2)" for k in range(15, 0, -2))
    parts = [f"'{order}{whole(6)}{whole(2)}'"]
    for a, b in (("xmin", "middle"), ("middle", "xmax")):
        parts.append(f"'{order}{whole(3)}{whole(1)}{whole(5)}'")
        parts += [double(side) for corner in corners(a, b) for side in corner]
    return f"unhex({' || '.join(parts)})"


def _bits(side: str) -> str:
    """SQL for the bits of a double of few leading bits as 16 hexadecimal digits."""
    exponent = f"cast(floor(log2(abs({side}))) as int)"
    fraction = f"cast((abs({side}) / power(2, {exponent}) - 1) * 1048576 as bigint)"  # 20 bits are enough
    high = f"(if({side} < 0, 2048L, 0L) + 1023 + {exponent}) * 1048576 + {fraction}"
    return f"if({side} = 0, '{'0' * 16}', lpad(lower(hex({high})), 8, '0') || '{'0' * 8}')"


@register(
    shape(str="country", num="xmin ymin xmax ymax"),
    "SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS country, CASE WHEN w THEN -180 ELSE 10 * n_nationkey - 120 END AS xmin, "
    "CASE WHEN w THEN -90 ELSE -60 END AS ymin, CASE WHEN w THEN 180 ELSE 10 * n_nationkey - 111 END AS xmax, CASE WHEN w THEN 90 ELSE 60 END AS ymax "
    "FROM (SELECT n_nationkey, n_nationkey % 5 = 0 AS w FROM nation) "
    "UNION ALL SELECT unnest(['STATELESS', 'SPECIAL_REGIONS']), -180, -90, 180, 90",
)
def boundary_envelopes(spark, sf_dir):
    """Boundaries written as multi-polygons in both byte orders, with a part under a one-letter code, and read as boxes."""
    middle = view.boundaries(spark, sf_dir).withColumn("middle", F.expr("(xmin + xmax) / 2"))
    sides = {side: _bits(side) for side in ("xmin", "ymin", "xmax", "ymax", "middle")}
    geometry = F.when(F.crc32("iso") % 2 == 0, F.expr(_two_parts(sides, "00"))).otherwise(F.expr(_two_parts(sides, "01")))
    stored = middle.select("iso", geometry.alias("geometry"))
    short = stored.select(F.lit("N").alias("iso"), "geometry")  # codes of one letter name no country
    path = f"{staging_root(spark)}/editpulse-boundaries-{uuid.uuid4().hex}"
    stored.union(short).write.parquet(path)
    return E.country_boxes(read_boundaries(spark, path)).select("country", "country_box.*")


def _country_spread(spark, sf_dir, profile="medium"):
    return U.user_totals(U.user_country_sums(activity(spark, sf_dir, profile), ["edit_count"]))


@register(
    USER | shape(num="entropy_country_distribution", int="number_of_countries"),
    "SELECT * FROM life_spread",
    with_parts("medium", "life_spread"),
)
def country_entropy(spark, sf_dir):
    return _country_spread(spark, sf_dir)


@register(
    USER | shape(str="top_country", int="max_country_edits"), "SELECT * FROM life_spread", with_parts("medium", "life_spread")
)
def top_country(spark, sf_dir):
    return _country_spread(spark, sf_dir)


def _breadth_query(name: str, columns: Shape) -> None:
    def build(spark, sf_dir):
        core = D.daily_core(enriched(spark, sf_dir, "medium"))
        names = ["edit_count", *D.FEATURE_COLUMNS.values()]
        return U.feature_breadth(U.user_totals(U.user_country_sums(core, names)))

    build.__name__ = name
    sums = ", ".join(f"count(*) FILTER ({feature}) AS total_{feature}" for feature in rules.FEATURES)
    register(
        USER | columns,
        f"SELECT *, largest AS max_featuretype_count, summed AS total_featuretype_edits FROM "
        f"(SELECT *, {S.breadth_sql()} FROM (SELECT user_id, {sums} FROM enriched GROUP BY user_id))",
        with_parts("medium", "enriched"),
    )(build)


_breadth_query("top_feature_type", shape(str="top_feature_type_name", int="max_featuretype_count"))
_breadth_query("feature_breadth", shape(int="feature_category_count total_featuretype_edits"))


# ------------------------------------------------------------------ summaries
_SUMMARY_KINDS = {
    "day": {"first_edit", "full_last_edit"},
    "str": {"top_country", "top_feature_type_name"},
    "bool": {"left_early"},
    "int": {
        "user_id", "first_edit_year", "first_edit_month", "true_edit_days", "active_duration", "pause_after_first_edit",
        "pause_after_first_editing_day", "number_of_countries", "max_country_edits", "total_edits",
        "feature_category_count", "active_weeks_26", "active_weeks", "days_to_50", "days_to_100",
    },
}
_TIMES = "user_id first_edit full_last_edit first_edit_year true_edit_days active_duration activity_ratio_true edits_per_day_true mean_days_between_edits_true pause_after_first_edit first_edit_month"
_PLACES = "top_country_ratio entropy_country_distribution diversity_score number_of_countries max_country_edits top_country"
_EDITS = "created_ratio deleted_ratio tag_ratio geometry_ratio none_ratio total_edits"
_FEATURES = " ".join(f"{feature}_ratio" for feature in rules.FEATURES) + " feature_category_count top_feature_ratio top_feature_type_name"
_CONTENT = "node_ratio way_ratio relation_ratio geometry_tag_ratio new_keys_ratio deleted_keys_ratio keys_per_changeset_ratio edits_per_changeset_ratio changeset_duration_ratio_in_sec josm_changeset_ratio id_changeset_ratio streetcomplete_changeset_ratio other_id_changeset_ratio comment_length_ratio changesets_per_edit_day avg_days_valid_per_edit"
_END = "days_to_50 days_to_100 frontload_ratio early_days_ratio activity_density left_early"


def _summary_shape(*groups: str) -> Shape:
    names = " ".join(groups).split()
    return {n: next((kind for kind, members in _SUMMARY_KINDS.items() if n in members), "num") for n in names}


PREDICTION_SHAPE = _summary_shape(_TIMES, _PLACES, _EDITS, "burstiness", _FEATURES, _CONTENT, "active_weeks_26", _END)
CATEGORIZATION_SHAPE = _summary_shape(
    _TIMES, "pause_after_first_editing_day", _PLACES, _EDITS, "burstiness_score", _FEATURES, _CONTENT,
    "active_weeks active_week_ratio edits_per_span_day", _END,
)


@register(PREDICTION_SHAPE, "SELECT * FROM prediction ORDER BY user_id", with_parts("sparse", "prediction"))
def prediction_summary(spark, sf_dir):
    return prediction(spark, sf_dir).orderBy("user_id")


@register(CATEGORIZATION_SHAPE, "SELECT * FROM categorization ORDER BY user_id", with_parts("sparse", "categorization"))
def categorization_summary(spark, sf_dir):
    return categorization(spark, sf_dir).orderBy("user_id")


@register(PREDICTION_SHAPE, "SELECT * FROM prediction", with_parts("dense", "prediction"))
def prediction_summary_dense(spark, sf_dir):
    return prediction(spark, sf_dir, "dense")


@register(CATEGORIZATION_SHAPE, "SELECT * FROM categorization", with_parts("medium", "categorization"))
def categorization_summary_medium(spark, sf_dir):
    return categorization(spark, sf_dir, "medium")
