"""DuckDB statements for the same contribution log, as named WITH parts.

Each part names the parts it builds on; ``with_parts`` collects them in order.
"""

from __future__ import annotations

from checks.contribution_view import (
    COHORT_SNAPSHOT, EDIT_KINDS, EDITORS, PROFILES, RANGE_END, RANGE_START, TAG_SETS, VALIDITY_SNAPSHOT,
)
from editpulse.functions import rules


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _map_literal(tags: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tags.items()) + "}"


def _case(subject: str, choices: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items()) + " END"


def log_part(profile: str) -> str:
    sets = "[" + ", ".join(map(_map_literal, TAG_SETS)) + "]"
    return f"""
log AS (
  SELECT CASE WHEN l_linenumber = 7 THEN []::VARCHAR[]
              WHEN l_partkey % 50 = 0 THEN [printf('N%02d', s_nationkey), 'CP', 'XA']
              WHEN l_linenumber % 3 = 0 THEN [printf('N%02d', s_nationkey), printf('N%02d', c_nationkey)]
              ELSE [printf('N%02d', s_nationkey)] END AS countries,
         l_partkey * 10 + l_linenumber AS osm_id,
         ['relation', 'node', 'way'][l_linenumber % 3 + 1] AS osm_type,
         {PROFILES[profile]} AS user_id,
         l_shipdate + to_hours(l_linenumber) AS valid_from,
         CASE WHEN l_returnflag <> 'N'
              THEN l_shipdate + to_hours(l_linenumber) + to_days(floor(l_quantity)::INTEGER) END AS valid_to,
         {sets}[l_partkey % 20 + 1] AS tags,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F'
              THEN CASE WHEN l_linenumber % 2 = 1 THEN MAP {{}}::MAP(VARCHAR, VARCHAR) END
              ELSE {sets}[(l_partkey + floor(l_quantity)::BIGINT) % 20 + 1] END AS tags_before,
         {_case("l_returnflag || l_linestatus", EDIT_KINDS)} AS contrib_type,
         l_orderkey * 8 + l_linenumber AS changeset_id,
         {_case("o_orderpriority[1]", EDITORS)} AS editor,
         CASE WHEN l_tax <> 0 THEN p_name END AS comment,
         o_orderdate AS created_at,
         o_orderdate + to_minutes(floor(l_quantity)::BIGINT) AS closed_at,
         -120 + 10 * s_nationkey + l_quantity / 10 AS xmin,
         -120 + 10 * s_nationkey + l_quantity / 10 + l_discount * 50 AS xmax,
         l_tax * -100 AS ymin, l_tax * 100 AS ymax
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN customer ON c_custkey = o_custkey
  JOIN part ON p_partkey = l_partkey
)"""


BOXES = f"""
box AS (
  SELECT printf('N%02d', n_nationkey) AS iso,
         CASE WHEN n_nationkey % 5 = 0 THEN -180.0 ELSE n_nationkey * 10 - 120 END::DOUBLE AS west,
         CASE WHEN n_nationkey % 5 = 0 THEN -90.0 ELSE -60 END::DOUBLE AS south,
         CASE WHEN n_nationkey % 5 = 0 THEN 180.0 ELSE n_nationkey * 10 - 111 END::DOUBLE AS east,
         CASE WHEN n_nationkey % 5 = 0 THEN 90.0 ELSE 60 END::DOUBLE AS north
  FROM nation
  UNION ALL SELECT unnest(['{rules.STATELESS}', '{rules.SPECIAL_REGIONS}']), -180, -90, 180, 90
)"""

SPECIAL = f"list_has_any(countries, [{quoted(rules.SPECIAL_REGION_CODES)}])"
ASSIGNED = f"""
labelled AS (
  SELECT *, unnest(list_concat(
      list_filter(list_distinct(countries), lambda c: c[1] = 'N'),
      CASE WHEN len(countries) = 0 THEN ['{rules.STATELESS}'] ELSE [] END,
      CASE WHEN {SPECIAL} THEN ['{rules.SPECIAL_REGIONS}'] ELSE [] END)) AS country
  FROM log
  WHERE valid_from >= TIMESTAMP '{RANGE_START}' AND valid_from < TIMESTAMP '{RANGE_END}'
),
assigned AS (
  SELECT labelled.*, valid_from::DATE AS edit_date
  FROM labelled JOIN box ON country = iso
   AND xmin >= west AND xmax <= east AND ymin >= south AND ymax <= north
)"""


def tag_test(test: rules.TagTest, source: str = "tags") -> str:
    value = f"{source}['{test.key}']"
    if test.values is not None:
        return f"{value} IN ({quoted(test.values)})"
    if test.excluded is not None:
        return f"({value} IS NOT NULL AND {value} <> '{test.excluded}')"
    return f"{value} IS NOT NULL"


def flag_sql(feature: str) -> str:
    return " OR ".join(tag_test(test) for test in rules.FEATURE_FLAGS[feature])


def category_sql(branches) -> str:
    lines = []
    for category, test in branches:
        hit = f"e.key = '{test.key}'"
        if test.values is not None:
            hit += f" AND e.value IN ({quoted(test.values)})"
        elif test.excluded is not None:
            hit += f" AND e.value <> '{test.excluded}'"
        lines.append(f"WHEN {hit} THEN '{category}'")
    return "CASE " + " ".join(lines) + f" ELSE '{rules.OTHER}' END"


def keys_sql(own: str, other: str) -> str:
    return (
        f"CASE WHEN {other} IS NULL AND {own} IS NOT NULL THEN []::VARCHAR[] "
        f"ELSE list_filter(map_keys({own}), lambda k: NOT list_contains(map_keys({other}), k)) END"
    )


def categories_sql(own: str, other: str, branches) -> str:
    return (
        f"CASE WHEN {other} IS NULL AND {own} IS NOT NULL THEN []::VARCHAR[] ELSE list_transform(list_filter("
        f"map_entries({own}), lambda e: NOT list_contains(map_keys({other}), e.key)), "
        f"lambda e: {category_sql(branches)}) END"
    )


EDITOR_SQL = (
    "CASE WHEN lower(editor) LIKE '%josm%' THEN 'JOSM' WHEN lower(editor) LIKE 'id%' THEN 'iD' "
    "WHEN lower(editor) LIKE '%streetcomplete%' THEN 'Streetcomplete' ELSE 'other' END"
)
VALID_MICROS = (
    f"epoch_us(CASE WHEN valid_to IS NULL OR valid_to > TIMESTAMP '{VALIDITY_SNAPSHOT}' "
    f"THEN TIMESTAMP '{VALIDITY_SNAPSHOT}' ELSE valid_to END) - epoch_us(valid_from)"
)
ENRICHED = f"""
enriched AS (
  SELECT *,
         {keys_sql("tags", "tags_before")} AS new_keys,
         {keys_sql("tags_before", "tags")} AS removed_keys,
         {categories_sql("tags", "tags_before", rules.ADDED_KEY_CATEGORIES)} AS added,
         {categories_sql("tags_before", "tags", rules.REMOVED_KEY_CATEGORIES)} AS removed,
         {EDITOR_SQL} AS editor_category,
         epoch_us(closed_at) - epoch_us(created_at) AS duration_micros,
         {VALID_MICROS} AS valid_micros,
         length(comment) AS length_comment,
         {", ".join(f"({flag_sql(feature)}) AS {feature}" for feature in rules.FEATURES)}
  FROM assigned
)"""

DAYS = """
activity AS (
  SELECT user_id, country, edit_date, count(*) AS edit_count
  FROM assigned GROUP BY ALL
)"""


# ------------------------------------------------------------------ daily table
def _daily_core() -> str:
    flags = ", ".join(rules.FEATURES)
    counts = [
        *(f"count(*) FILTER (osm_type = '{kind}') AS count_{kind}_per_day" for kind in rules.OBJECT_TYPES),
        "count(*) AS edit_count",
        *(
            f"count(*) FILTER (contrib_type = '{kind}') AS count_{total}_per_day"
            for kind, (total, _) in rules.EDIT_TYPES.items()
        ),
        *(f"count(*) FILTER ({feature}) AS count_{feature}_per_day" for feature in rules.FEATURES),
        *(
            f"count(*) FILTER ({feature} AND contrib_type = '{kind}') AS {feature}_{cell}_per_day"
            for feature in rules.FEATURES
            for kind, (_, cell) in rules.EDIT_TYPES.items()
        ),
    ]
    return f"""
validity AS (
  SELECT user_id, country, edit_date, sum(valid_micros)::DOUBLE / 86400000000 AS total_days_valid
  FROM (SELECT DISTINCT user_id, country, edit_date, contrib_type, osm_type, valid_micros, {flags} FROM enriched)
  GROUP BY ALL
),
counted AS (SELECT user_id, country, edit_date, {", ".join(counts)} FROM enriched GROUP BY ALL),
core AS (SELECT * FROM counted JOIN validity USING (user_id, country, edit_date))"""


CHANGESETS = """
bundles AS (
  SELECT user_id, country, changeset_id, list({'day': edit_date, 'editor': editor_category}) AS touches,
         list({'took': coalesce(duration_micros, -1), 'words': length_comment}) AS edits
  FROM enriched GROUP BY ALL
),
spans AS (
  SELECT user_id, country, touches, edits, unnest(list_distinct(list_transform(edits, lambda e: e.took))) AS took
  FROM bundles
),
spread_days AS (
  SELECT user_id, country, touches, took, list_filter(edits, lambda e: e.took = took) AS same,
         unnest(list_distinct(list_transform(touches, lambda t: t.day))) AS edit_date
  FROM spans
),
touched AS (
  SELECT user_id, country, edit_date, nullif(took, -1) AS took, len(same) AS n, list_max(list_transform(same, lambda e: e.words)) AS words,
         list_min(list_transform(list_filter(touches, lambda t: t.day = edit_date), lambda t: t.editor)) AS editor
  FROM spread_days
),
changesets AS (
  SELECT user_id, country, edit_date,
         sum(words) AS total_comment_length_per_day, avg(n) AS avg_edits_per_changeset_per_day,
         sum((editor = 'JOSM')::INT) AS count_josm_changesets_per_day, sum((editor = 'iD')::INT) AS count_id_changesets_per_day,
         sum((editor = 'Streetcomplete')::INT) AS count_streetcomplete_changesets_per_day,
         sum((editor = 'other')::INT) AS count_other_id_changesets_per_day,
         count(*) AS total_changesets_per_day, sum(took)::DOUBLE / 1000000 AS total_changeset_duration_per_day_in_sec
  FROM touched GROUP BY ALL
)"""


def _tag_changes() -> str:
    def counts(array: str, prefix: str) -> str:
        return ", ".join(
            f"CASE WHEN sum(len({array})) > 0 THEN "
            f"coalesce(sum(len(list_filter({array}, lambda c: c = '{name}'))), 0) END AS {prefix}_{suffix}_per_day"
            for name, suffix in rules.CATEGORY_SUFFIX.items()
        )

    return f"""
tag_changes AS (
  SELECT user_id, country, edit_date,
         sum(len(new_keys)) AS total_new_keys_per_day, sum(len(removed_keys)) AS total_removed_keys_per_day,
         {counts("added", "new_key")}, {counts("removed", "removed_key")}
  FROM enriched GROUP BY ALL
)"""


DAILY = """
daily AS (
  SELECT * FROM core
  LEFT JOIN changesets USING (user_id, country, edit_date)
  LEFT JOIN tag_changes USING (user_id, country, edit_date)
)"""

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "box": ((), BOXES),
    "assigned": (("log", "box"), ASSIGNED),
    "activity": (("assigned",), DAYS),
    "enriched": (("assigned",), ENRICHED),
    "core": (("enriched",), _daily_core()),
    "changesets": (("enriched",), CHANGESETS),
    "tag_changes": (("enriched",), _tag_changes()),
    "daily": (("core", "changesets", "tag_changes"), DAILY),
}


def add_part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def with_parts(profile: str, *names: str) -> str:
    """WITH clause holding the named parts and all they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name == "log":
            if "log" not in ordered:
                ordered.append("log")
            return
        for need in PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",".join(log_part(profile) if name == "log" else PARTS[name][1] for name in ordered) + "\n"


SNAPSHOT_DATE = COHORT_SNAPSHOT
