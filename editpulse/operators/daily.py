"""Daily rollup: enriched contributions to one row per user, country and day.

Every group of the full table lies inside a user, so narrow contributions are gathered by user once
for the counts and once for the changesets, and nothing is shuffled again.  Users with more rows
than a task may gather go through aggregates that Spark combines before each shuffle, so a very
active user, country or changeset never has its raw rows gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpulse.functions import rules
from editpulse.sources.staging import stage

DAY_KEY = ("user_id", "country", "edit_date")
MICROS_PER_DAY = 86_400_000_000
#: Contributions whose days one task rolls up, and the type code of rows that hold sums of changesets.
TASK_ROWS, CHANGESET_CODE = 100_000, -1
#: Contributions of one user that a task may gather.
GATHERED_ROWS = 100_000

# Output columns that hold the daily counts of contributions
TYPE_COLUMNS = {kind: f"count_{total}_per_day" for kind, (total, _) in rules.EDIT_TYPES.items()}
FEATURE_COLUMNS = {feature: f"count_{feature}_per_day" for feature in rules.FEATURES}
OBJECT_COLUMNS = {kind: f"count_{kind}_per_day" for kind in rules.OBJECT_TYPES}
MATRIX_COLUMNS = {
    (feature, kind): f"{feature}_{cell}_per_day"
    for feature in rules.FEATURES
    for kind, (_, cell) in rules.EDIT_TYPES.items()
}
CORE_COLUMNS = (
    "total_days_valid",
    *OBJECT_COLUMNS.values(),
    "edit_count",
    *TYPE_COLUMNS.values(),
    *FEATURE_COLUMNS.values(),
    *MATRIX_COLUMNS.values(),
)
CHANGESET_COLUMNS = (
    "total_comment_length_per_day",
    "avg_edits_per_changeset_per_day",
    *(f"count_{name}_changesets_per_day" for name in rules.EDITOR_COLUMNS.values()),
    "total_changesets_per_day",
    "total_changeset_duration_per_day_in_sec",
)
CHANGESET_SUMS = ("edits", "changesets", "comment_length", "duration_micros")
KEY_COLUMNS = ("total_new_keys_per_day", "total_removed_keys_per_day")
ADDED_COLUMNS = {name: f"new_key_{suffix}_per_day" for name, suffix in rules.CATEGORY_SUFFIX.items()}
REMOVED_COLUMNS = {name: f"removed_key_{suffix}_per_day" for name, suffix in rules.CATEGORY_SUFFIX.items()}
DAILY_COLUMNS = (
    *DAY_KEY, *CORE_COLUMNS, *CHANGESET_COLUMNS, *KEY_COLUMNS, *ADDED_COLUMNS.values(), *REMOVED_COLUMNS.values(),
)


def _flag_code() -> Column:
    """The states of all flags (FALSE 0, TRUE 1, NULL 2) as one integer, two bits each."""
    states = (
        f"shiftleft(CASE WHEN {name} THEN 1 WHEN NOT {name} THEN 0 ELSE 2 END, {2 * place})"
        for place, name in enumerate(rules.FEATURES)
    )
    return F.expr(" | ".join(states))


def _sum_if(condition: str, value: str, name: str) -> Column:
    return F.expr(f"sum(CASE WHEN {condition} THEN {value} ELSE 0L END) AS {name}")


# Group keys as small numbers: fixed-width keys hash and compare faster than strings in
# the 100-odd conditional sums.
_TYPE_CODES = {kind: place for place, kind in enumerate(rules.EDIT_TYPES, 1)}
_OBJECT_CODES = {kind: place for place, kind in enumerate(rules.OBJECT_TYPES, 1)}

# Editor labels in text order, so the smallest position is the smallest label.  Numbers keep the
# aggregation hash-based; a minimum over strings would make Spark sort instead.
_EDITOR_LABELS = sorted(rules.EDITOR_COLUMNS)


# Category lists are kept as texts of one letter a key, a fraction of the bytes to write and to shuffle.
_LETTERS = {name: chr(ord("a") + place) for place, name in enumerate(rules.CATEGORY_SUFFIX)}


def _lettered(array: str) -> Column:
    names, letters = ", ".join(map(repr, _LETTERS)), "".join(_LETTERS.values())
    return F.expr(f"array_join(transform({array}, c -> substr('?{letters}', cast(array_position(array({names}), c) AS int) + 1, 1)), '') AS {array}")


def _emitted(branches: tuple) -> list[str]:
    """Categories the branches can produce, in column order."""
    produced = {rules.OTHER, *(category for category, _ in branches)}
    return [name for name in rules.CATEGORY_SUFFIX if name in produced]


def _category_counts() -> dict[str, str]:
    """Row-level number of added and removed keys per category, as SQL on ``_lettered`` lists."""
    counts = {}
    for array, columns, branches in (
        ("new_feature_categories", ADDED_COLUMNS, rules.ADDED_KEY_CATEGORIES),
        ("removed_feature_categories", REMOVED_COLUMNS, rules.REMOVED_KEY_CATEGORIES),
    ):
        for name in _emitted(branches):
            counts[columns[name]] = (
                f"CASE WHEN length({array}) > 0 THEN length({array}) - length(replace({array}, '{_LETTERS[name]}', '')) ELSE 0 END"
            )
    return counts


_CATEGORY_COUNTS = _category_counts()


def _code(column: str, codes: dict[str, int]) -> str:
    """Number of a known value; values outside the domain keep a number of their own."""
    known = " ".join(f"WHEN '{value}' THEN {code}L" for value, code in codes.items())
    return f"CASE {column} {known} ELSE 100 + pmod(xxhash64({column}), 9007199254740881L) END"


def _tag_sums() -> list[Column]:
    """Sums of changed keys, in total and by the categories that can occur."""
    return [
        F.sum("length_new_keys").alias("total_new_keys_per_day"),
        F.sum("length_removed_keys").alias("total_removed_keys_per_day"),
        *(F.expr(f"sum({sql}) AS {column}") for column, sql in _CATEGORY_COUNTS.items()),
    ]


def _tag_columns() -> list[Column]:
    """Final tag-change columns: categories are NULL on days without any such key, and
    categories that never occur are zero otherwise."""
    categories = [
        F.expr(f"CASE WHEN {total} > 0 THEN {column if column in _CATEGORY_COUNTS else '0L'} END AS {column}")
        for total, columns in (("total_new_keys_per_day", ADDED_COLUMNS), ("total_removed_keys_per_day", REMOVED_COLUMNS))
        for column in columns.values()
    ]
    return [*(F.col(name) for name in KEY_COLUMNS), *categories]


def daily_inputs(enriched: DataFrame, categories: bool = True) -> DataFrame:
    """The narrow columns the daily rollup reads, one row per contribution.

    This is what is worth writing between enrichment and rollup: tag maps and key lists
    are gone, flags are one integer and the category of a key is a letter.  What only sums up totals can do without ``categories``.
    """
    return enriched.select(
        *DAY_KEY,
        F.expr(_code("contrib_type", _TYPE_CODES)).alias("type_code"),
        F.expr(_code("osm_type", _OBJECT_CODES)).alias("object_code"),
        "validity_duration",
        _flag_code().alias("flag_code"),
        "length_new_keys",
        "length_removed_keys",
        *(map(_lettered, ("new_feature_categories", "removed_feature_categories")) if categories else ()),
        "changeset_id",
        "changeset_edit_duration",
        "length_comment",
        F.expr(f"array_position(array({', '.join(map(repr, _EDITOR_LABELS))}), editor_category)").alias("editor_rank"),
    )


def _as_inputs(rows: DataFrame) -> DataFrame:
    return rows if "flag_code" in rows.columns else daily_inputs(rows)


def split_heavy(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows that may be gathered by user, and those of buckets of users with more than ``limit`` rows (None without any).

    There are enough buckets for a full one to be rare, and their counts are all that is shuffled to find one.
    """
    buckets = max(64, 10 * rows.count() // limit)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    full = stage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("bucket"), "full-buckets")
    if full.isEmpty():
        return rows, None
    return tuple(placed.join(full, "bucket", how).drop("bucket") for how in ("left_anti", "left_semi"))


def gathered(rows: DataFrame) -> DataFrame:
    """All rows of a user in one task, with the columns that are read afterwards.

    A task takes about ``TASK_ROWS`` rows, so its memory does not follow the table.
    """
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), "user_id")


def fine_counts(rows: DataFrame, *extra: Column) -> DataFrame:
    """Contributions counted per day, flag states, edit type, object type and validity."""
    return (
        _as_inputs(rows)
        .groupBy(*DAY_KEY, "type_code", "object_code", "validity_duration", "flag_code")
        .agg(F.count(F.lit(1)).alias("contrib_count"), *extra)
    )


def _by_day(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with all rows of a day in one task.

    The wide rows of the day level are built after this and never shuffled. Staged inputs tell how many
    there can be, and a task takes about ``TASK_ROWS`` of them, so its memory does not follow the table.
    """
    tasks = [max(1, -(-rows.count() // TASK_ROWS))] if "flag_code" in rows.columns else []
    return cells.repartition(*tasks, *(F.col(name) for name in DAY_KEY))


def _rollup(rows: DataFrame, weighted_validity: bool, with_tags: bool, changesets: DataFrame | None = None, in_place: bool = False) -> DataFrame:
    """Counts per day; with rows of ``changeset_days`` also their statistics, summed up in the same groups.

    Rows ``in_place`` are gathered already, as are their changesets.
    """
    tag_names = [*KEY_COLUMNS, *_CATEGORY_COUNTS] if with_tags else []
    carried = [F.expr(f"sum({name}) AS {name}") for name in tag_names]
    counted = "validity_duration * contrib_count" if weighted_validity else "validity_duration"
    # as many rows a day as there are flag states, whatever the day's edits
    cells = (
        fine_counts(rows, *(_tag_sums() if with_tags else ()))
        .groupBy(*DAY_KEY, "type_code", "object_code", "flag_code")
        .agg(F.expr(f"sum({counted}) AS valid_micros"), F.sum("contrib_count").alias("contrib_count"), *carried)
    )
    passed = []
    if changesets is not None:
        # a day without a whole key has no statistics
        sums = changesets.groupBy(*DAY_KEY, "editor_rank").agg(*(F.sum(name).alias(name) for name in CHANGESET_SUMS)).dropna(subset=list(DAY_KEY))
        marked = sums.select(*DAY_KEY, F.lit(CHANGESET_CODE).cast("long").alias("type_code"), *_changeset_parts())
        cells = cells.unionByName(marked, allowMissingColumns=True)
        passed = [F.sum(name).alias(name) for name in marked.columns if name not in (*DAY_KEY, "type_code")]
    per_type = (
        (cells if in_place else _by_day(rows, cells))
        .groupBy(*DAY_KEY, "type_code")
        .agg(
            F.sum("valid_micros").alias("valid_micros"),
            F.sum("contrib_count").alias("edits"),
            *(_sum_if(f"object_code = {code}", "contrib_count", kind) for kind, code in _OBJECT_CODES.items()),
            *(
                _sum_if(f"(shiftright(flag_code, {2 * place}) & 3) = 1", "contrib_count", feature)
                for place, feature in enumerate(rules.FEATURES)
            ),
            *carried,
            *passed,
        )
    )
    return per_type.groupBy(*DAY_KEY).agg(
        F.expr(f"sum(valid_micros) / {MICROS_PER_DAY}D AS total_days_valid"),
        *(F.expr(f"sum({kind}) AS {out}") for kind, out in OBJECT_COLUMNS.items()),
        F.sum("edits").alias("edit_count"),
        *(_sum_if(f"type_code = {_TYPE_CODES[kind]}", "edits", out) for kind, out in TYPE_COLUMNS.items()),
        *(F.expr(f"sum({feature}) AS {out}") for feature, out in FEATURE_COLUMNS.items()),
        *(_sum_if(f"type_code = {_TYPE_CODES[kind]}", feature, out) for (feature, kind), out in MATRIX_COLUMNS.items()),
        *carried,
        *(_changeset_columns() if changesets is not None else ()),
    )


def daily_core(rows: DataFrame, weighted_validity: bool = False) -> DataFrame:
    """Edit counts of a user-country-day, by object type, edit type and feature.

    ``total_days_valid`` adds each distinct (flags, edit type, object type, duration)
    combination once, however many edits share it.  That is the published definition;
    ``weighted_validity`` counts every edit instead.

    The counts are built in two steps, first per edit type (about 20 sums) and then across edit
    types.  The wide 112-column rows therefore only appear once rows are already down to
    a handful per day.
    """
    return _rollup(rows, weighted_validity, with_tags=False)


def daily_tag_changes(rows: DataFrame) -> DataFrame:
    """Added and removed keys of a user-country-day, in total and by category.

    The categories of a row are counted in place rather than exploded, so key totals and
    all category counts come from one aggregation with one narrow shuffle.
    """
    return _as_inputs(rows).groupBy(*DAY_KEY).agg(*_tag_sums()).select(*DAY_KEY, *_tag_columns())


def changeset_days(rows: DataFrame, per_day: bool = False, gathered: bool = False) -> DataFrame:
    """One row per changeset and day it touches, with the values of the changeset.

    By the published definition the edits, comment length and duration of a changeset
    count in full on each of its days; only the editor is taken from the day itself.
    With ``per_day`` a day only gets its own edits.

    Edits are condensed to one row per changeset, day and duration before any shuffle; windows over
    these few rows of a changeset share one partitioning with the aggregation to its days, so the
    table is read once and nothing is joined.  Rows that are ``gathered``, with all of a user in one
    task, pass the windows as they are.
    """
    changeset = ("changeset_id", "user_id", "country")  # the first one decides nearly every comparison of the sort
    if gathered and not per_day:
        parts = _as_inputs(rows).withColumn("edits", F.lit(1))
    else:
        parts = (
            _as_inputs(rows)
            .groupBy(*changeset, "edit_date", "changeset_edit_duration")
            .agg(F.count(F.lit(1)).alias("edits"), F.max("length_comment").alias("length_comment"), F.min("editor_rank").alias("editor_rank"))
        )
        parts = parts if gathered else parts.repartition(*(F.col(name) for name in changeset))
    values = CHANGESET_SUMS
    if per_day:
        summed = (F.sum("edits"), F.count(F.lit(1)), F.sum("length_comment"), F.sum("changeset_edit_duration"))
        return parts.groupBy(*changeset, "edit_date").agg(F.min("editor_rank").alias("editor_rank"), *(v.alias(n) for v, n in zip(summed, values)))
    same_duration = W.partitionBy(*changeset, "changeset_edit_duration")
    whole = W.partitionBy(*changeset)
    counted = parts.withColumns(
        {
            "first_part": F.row_number().over(same_duration.orderBy("edit_date")) == 1,
            "all_edits": F.sum("edits").over(same_duration),
            "longest_comment": F.max("length_comment").over(same_duration),
        }
    )
    once = lambda value: F.sum(F.when(F.col("first_part"), value)).over(whole)
    totals = (once(F.col("all_edits")), once(F.lit(1)), once(F.col("longest_comment")), once(F.col("changeset_edit_duration")))
    spread = counted.withColumns(dict(zip(values, totals)))
    return spread.groupBy(*changeset, "edit_date").agg(F.min("editor_rank").alias("editor_rank"), *(F.max(name).alias(name) for name in values))


def _changeset_parts() -> list[Column]:
    """Sums of ``changeset_days`` rows of one editor, with the changesets of each known editor in a column."""
    editors = (F.expr(f"CASE WHEN editor_rank = {_EDITOR_LABELS.index(label) + 1} THEN changesets ELSE 0L END AS changesets_{name}") for label, name in rules.EDITOR_COLUMNS.items())
    return [F.col("edits").alias("changeset_edits"), *(F.col(name) for name in CHANGESET_SUMS[1:]), *editors]


def _changeset_columns() -> list[Column]:
    return [
        F.sum("comment_length").alias("total_comment_length_per_day"),
        F.expr("sum(changeset_edits) / sum(changesets) AS avg_edits_per_changeset_per_day"),
        *(F.expr(f"sum(changesets_{name}) AS count_{name}_changesets_per_day") for name in rules.EDITOR_COLUMNS.values()),
        F.sum("changesets").alias("total_changesets_per_day"),
        F.expr("sum(duration_micros) / 1e6D AS total_changeset_duration_per_day_in_sec"),
    ]


def daily_changesets(rows: DataFrame, per_day: bool = False) -> DataFrame:
    """Changeset statistics of a user-country-day.

    A changeset with several distinct durations counts once per duration.
    """
    return changeset_days(rows, per_day).select(*DAY_KEY, *_changeset_parts()).groupBy(*DAY_KEY).agg(*_changeset_columns())


def daily_user_activity(
    rows: DataFrame, per_day_changesets: bool = False, weighted_validity: bool = False
) -> DataFrame:
    """The full daily table.

    ``rows`` are enriched contributions or, better at scale, the staged ``daily_inputs``
    of them.  Counts and tag changes share one pass.  The sums of changesets are rows
    of the same groups, so the wide rows are neither shuffled, sorted nor joined, and as
    contributions are gathered by user, neither is anything between.
    """
    light, heavy = split_heavy(_as_inputs(rows), GATHERED_ROWS)
    near = gathered(light)
    days = _rollup(near, weighted_validity, True, changeset_days(near, per_day_changesets, gathered=True), in_place=True)
    if heavy is not None:
        days = days.unionByName(_rollup(heavy, weighted_validity, True, changeset_days(heavy, per_day_changesets)))
    return days.select(*DAY_KEY, *CORE_COLUMNS, *CHANGESET_COLUMNS, *_tag_columns())
