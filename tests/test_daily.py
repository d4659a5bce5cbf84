from datetime import datetime

import pytest
from pyspark.sql import functions as F

from editpulse.functions import rules
from editpulse.operators import daily as D
from editpulse.operators import enrich as E
from editpulse.sources.staging import stage


def daily(rows, **options):
    labelled = E.assign_countries(rows, E.box_table(rows.sparkSession, [("AAA", -180.0, -90.0, 180.0, 90.0), ("BBB", -180.0, -90.0, 180.0, 90.0)]))
    result = D.daily_user_activity(E.enrich(labelled), **options).collect()
    return {(r["user_id"], r["country"], str(r["edit_date"])): r for r in result}


def test_column_count_and_order(contribution):
    row = next(iter(daily(contribution({})).values()))
    assert len(row) == 152 and tuple(row.asDict()) == D.DAILY_COLUMNS


def test_equal_edits_count_one_duration(contribution):
    rows = contribution({"osm_id": 1}, {"osm_id": 2}, {"osm_id": 3, "osm_type": "way"})
    (row,) = daily(rows).values()
    assert row["edit_count"] == 3 and row["total_days_valid"] == pytest.approx(2.0)
    (row,) = daily(rows, weighted_validity=True).values()
    assert row["total_days_valid"] == pytest.approx(3.0)


def test_null_and_false_flags_are_different_groups(contribution):
    rows = contribution({"tags": {"note": "x"}}, {"tags": {"water": "other"}})
    (row,) = daily(rows).values()
    assert row["total_days_valid"] == pytest.approx(2.0) and row["count_body_of_water_per_day"] == 0


def test_changeset_counts_in_full_on_each_day(contribution):
    day_two = {"valid_from": datetime(2020, 1, 2, 1), "editor": "iD"}
    result = daily(contribution({}, {}, {}, day_two))
    first, second = result[1, "AAA", "2020-01-01"], result[1, "AAA", "2020-01-02"]
    for row in (first, second):
        assert row["avg_edits_per_changeset_per_day"] == 4
        assert row["total_changeset_duration_per_day_in_sec"] == 600
        assert row["total_comment_length_per_day"] == 3 and row["total_changesets_per_day"] == 1
    assert first["count_josm_changesets_per_day"] == 1 and second["count_id_changesets_per_day"] == 1
    result = daily(contribution({}, {}, {}, day_two), per_day_changesets=True)
    assert result[1, "AAA", "2020-01-01"]["avg_edits_per_changeset_per_day"] == 3
    assert result[1, "AAA", "2020-01-02"]["avg_edits_per_changeset_per_day"] == 1


def test_changeset_with_two_durations_counts_twice(contribution):
    (row,) = daily(contribution({}, {"closed": datetime(2020, 1, 1, 12, 30)})).values()
    assert row["total_changesets_per_day"] == 2 and row["avg_edits_per_changeset_per_day"] == 1
    assert row["total_changeset_duration_per_day_in_sec"] == 2400


def test_category_counts_are_null_without_changed_keys(contribution):
    (row,) = daily(contribution({})).values()
    assert row["new_key_building_per_day"] is None and row["removed_key_other_per_day"] is None
    assert row["total_new_keys_per_day"] == 0 and row["total_removed_keys_per_day"] is None
    (row,) = daily(contribution({"tags": {"office": "a", "name": "b", "ref": "c"}, "tags_before": {}})).values()
    assert row["new_key_poi_per_day"] == 1 and row["new_key_other_per_day"] == 2
    assert row["new_key_educational_institution_per_day"] == 0 and row["removed_key_building_per_day"] is None


def test_countries_are_kept_apart(contribution):
    result = daily(contribution({"countries": ["AAA", "BBB"]}, {"countries": ["BBB"]}))
    assert result[1, "AAA", "2020-01-01"]["edit_count"] == 1 and result[1, "BBB", "2020-01-01"]["edit_count"] == 2
    assert result[1, "BBB", "2020-01-01"]["avg_edits_per_changeset_per_day"] == 2


def test_counts_add_up(contribution):
    kinds = [*rules.EDIT_TYPES]
    rows = contribution(
        *(
            {"contrib_type": kind, "osm_type": osm, "tags": {"amenity": "bank"}}
            for kind in kinds
            for osm in rules.OBJECT_TYPES
        )
    )
    (row,) = daily(rows).values()
    assert row["edit_count"] == 18
    assert sum(row[c] for c in D.TYPE_COLUMNS.values()) == 18 and sum(row[c] for c in D.OBJECT_COLUMNS.values()) == 18
    assert row["amenity_none_per_day"] == 3 and row["financial_service_tag_and_geometry_per_day"] == 3
    assert all(row[c] <= 18 for c in D.FEATURE_COLUMNS.values())


def test_staged_inputs_give_the_same_table(spark, contribution):
    from editpulse.sources.staging import stage

    rows = contribution({}, {"user": 2, "tags": {"shop": "x"}, "tags_before": {"name": "y"}}, {"editor": None})
    enriched = E.enrich(E.assign_countries(rows, E.box_table(rows.sparkSession, [("AAA", -180.0, -90.0, 180.0, 90.0)])))
    direct = D.daily_user_activity(enriched).collect()
    staged = D.daily_user_activity(stage(D.daily_inputs(enriched), "test")).collect()
    assert sorted(map(str, direct)) == sorted(map(str, staged))


def test_changesets_read_once_without_a_join(spark, contribution):
    rows = contribution({}, {"user": 2, "changeset": 5})
    boxes = E.box_table(spark, [("AAA", -180.0, -90.0, 180.0, 90.0)])
    inputs = stage(D.daily_inputs(E.enrich(E.assign_countries(rows, boxes))), "inputs")
    plan = D.daily_changesets(inputs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan and plan.count("Scan") == 1


def test_wide_rows_are_built_after_the_last_shuffle(spark, contribution, monkeypatch):
    raw = contribution(*({"user": 1 + k % 7, "osm_id": k, "changeset": k // 2} for k in range(40)))
    inputs = D.daily_inputs(E.enrich(raw.withColumn("country", F.lit("AAA"))))
    monkeypatch.setattr(D, "TASK_ROWS", 10)
    daily = D.daily_user_activity(inputs)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # statistics of changesets are rows of the same groups
    assert daily.rdd.getNumPartitions() == 4  # 10 contributions a task
    got = {r["user_id"]: r for r in daily.collect()}
    assert {u: r["edit_count"] for u, r in got.items()} == {u: 6 if u <= 5 else 5 for u in range(1, 8)}
    changes = {r["user_id"]: r for r in D.daily_changesets(inputs).collect()}
    for user, row in got.items():
        assert {c: row[c] for c in D.CHANGESET_COLUMNS} == {c: changes[user][c] for c in D.CHANGESET_COLUMNS}


def test_contributions_are_shuffled_twice_and_heavy_groups_give_the_same_table(spark, contribution, monkeypatch):
    def row(k):
        tags = ({"building": "yes", "ref": "1", "shop": "x"}, {"office": "a"}, None)[k % 3]
        return {
            "user": None if k % 11 == 0 else k % 4 // 2, "osm_id": k, "changeset": k // 3, "tags": tags, "tags_before": ({}, {"building": "no"}, None)[k % 5 % 3],
            "valid_from": datetime(2020, 1, 1 + k % 3, 12), "closed": datetime(2020, 1, 1, 12, 10 + k % 2), "editor": ("JOSM/1", "iD 2", None)[k % 7 % 3],
        }

    raw = contribution(*map(row, range(60)), *map(row, range(20)))
    rows = stage(D.daily_inputs(E.enrich(raw.withColumn("country", F.when(F.col("osm_id") % 13 != 0, "AAA")))), "inputs")
    monkeypatch.setattr(D, "TASK_ROWS", 20)
    for options, limit in (({}, 30), ({"per_day_changesets": True}, 1)):
        light = D.daily_user_activity(rows, **options)
        assert light._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        with monkeypatch.context() as m:
            m.setattr(D, "GATHERED_ROWS", limit)
            assert sorted(map(str, D.daily_user_activity(rows, **options).collect())) == sorted(map(str, light.collect()))
