from datetime import datetime

import pytest
from pyspark.sql import functions as F

from editpulse.functions import rules
from editpulse.operators import enrich as E

WORLD = ("AAA", -180.0, -90.0, 180.0, 90.0)


def first(df):
    return df.first().asDict()


def test_missing_previous_tags_give_no_added_keys(contribution):
    row = first(E.enrich(contribution({"tags_before": None, "tags": {"building": "yes", "name": "x"}})))
    assert row["new_keys"] == [] and row["length_new_keys"] == 0
    assert row["new_feature_categories"] == []
    assert row["removed_keys"] is None and row["length_removed_keys"] is None


def test_added_and_removed_keys(contribution):
    row = first(E.enrich(contribution({"tags": {"a": "1", "shop": "x"}, "tags_before": {"a": "2", "building": "yes", "old": "1"}})))
    assert row["new_keys"] == ["shop"] and row["new_feature_categories"] == ["shop"]
    assert sorted(row["removed_keys"]) == ["building", "old"]
    assert sorted(row["removed_feature_categories"]) == ["building", "other"]


@pytest.mark.parametrize(
    "tags, category",
    [
        ({"building": "no"}, "other"),
        ({"building": "school"}, "building"),
        ({"amenity": "school"}, "amenity"),
        ({"amenity": "bank"}, "amenity"),
        ({"waterway": "dam"}, "land_use"),
        ({"waterway": "river"}, "waterway"),
        ({"office": "ngo"}, "point_of_interest"),
        ({"man_made": "pump"}, "wash_facility"),
        ({"natural": "wood"}, "land_use"),
        ({"natural": "tree"}, "other"),
    ],
)
def test_first_matching_category_wins(contribution, tags, category):
    row = first(E.enrich(contribution({"tags": tags, "tags_before": {}})))
    assert row["new_feature_categories"] == [category]


def test_flags_are_three_valued(contribution):
    row = first(E.enrich(contribution({"tags": {"building": "no"}})))
    assert row["building"] is False and row["road"] is False
    assert row["body_of_water"] is None and row["place"] is None
    row = first(E.enrich(contribution({"tags": {"water": "ditch", "amenity": "bank"}})))
    assert row["body_of_water"] is False and row["financial_service"] is True and row["point_of_interest"] is True


@pytest.mark.parametrize(
    "editor, family",
    [("ideditor", "iD"), ("JOSM", "JOSM"), ("xjosmx", "JOSM"), ("StreetComplete 50", "Streetcomplete"), ("Vespucci", "other"), (None, "other")],
)
def test_editor_family(contribution, editor, family):
    assert first(E.enrich(contribution({"editor": editor})))["editor_category"] == family


def test_open_validity_is_clamped_to_the_snapshot(contribution):
    rows = contribution(
        {"valid_to": None},
        {"valid_to": datetime(2030, 1, 1)},
        {"valid_from": datetime(2020, 1, 1), "valid_to": datetime(2020, 1, 1, 0, 0, 1)},
    )
    durations = [r["validity_duration"] for r in E.enrich(rows, "2020-01-02 12:00:00").collect()]
    assert durations == [86_400_000_000, 86_400_000_000, 1_000_000]


def test_duration_and_comment(contribution):
    row = first(E.enrich(contribution({"comment": None})))
    assert row["length_comment"] is None and row["changeset_edit_duration"] == 600_000_000


def labels(df):
    return sorted(r["country"] for r in df.collect())


def test_row_in_two_countries_counts_in_both(contribution):
    boxes = [WORLD, ("BBB", -1.0, -1.0, 2.0, 2.0), ("CCC", 5.0, 5.0, 6.0, 6.0)]
    rows = contribution({"countries": ["AAA", "BBB", "AAA", "CCC"]})
    assert labels(E.assign_countries(rows, E.box_table(rows.sparkSession, boxes))) == ["AAA", "BBB"]


def test_pseudo_countries(contribution):
    boxes = [WORLD, (rules.STATELESS, *rules.WORLD_BOUNDS), (rules.SPECIAL_REGIONS, *rules.WORLD_BOUNDS)]
    rows = contribution({"countries": []}, {"countries": ["CP", "XA"]}, {"countries": ["XF"]}, {"countries": None})
    assert labels(E.assign_countries(rows, E.box_table(rows.sparkSession, boxes))) == [rules.SPECIAL_REGIONS, rules.STATELESS]


def test_box_borders_and_time_range(contribution):
    box = ("AAA", 0.0, 0.0, 1.0, 1.0)
    rows = contribution(
        {"bbox": (0.0, 0.0, 1.0, 1.0)},
        {"bbox": (0.0, 0.0, 1.1, 1.0)},
        {"valid_from": datetime(2007, 1, 1)},
        {"valid_from": datetime(2006, 12, 31, 23, 59, 59)},
        {"valid_from": datetime(2025, 7, 29)},
    )
    assert E.assign_countries(rows, E.box_table(rows.sparkSession, [box])).count() == 2
    assert E.country_contributions(rows, box).count() == 2


def test_one_scan_equals_one_run_per_country(contribution):
    boxes = [WORLD, ("BBB", 0.0, 0.0, 1.0, 1.0), (rules.STATELESS, *rules.WORLD_BOUNDS)]
    rows = contribution(
        {"osm_id": 1, "countries": ["AAA", "BBB"]},
        {"osm_id": 2, "countries": ["BBB"], "bbox": (0.0, 0.0, 3.0, 1.0)},
        {"osm_id": 3, "countries": []},
    )
    single = E.assign_countries(rows, E.box_table(rows.sparkSession, boxes)).select("osm_id", "country")
    runs = [E.country_contributions(rows, box).select("osm_id", "country") for box in boxes]
    merged = runs[0].union(runs[1]).union(runs[2])
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, merged.collect()))


def test_country_boxes(spark):
    parts = spark.createDataFrame(
        [("AAA", 0.0, 0.0, 1.0, 1.0), ("AAA", -5.0, 2.0, 0.5, 3.0), ("A", 0.0, 0.0, 9.0, 9.0)],
        "iso string, xmin double, ymin double, xmax double, ymax double",
    )
    assert [(r.country, *r.country_box) for r in E.country_boxes(parts, ["aaa"]).collect()] == [("AAA", -5.0, 0.0, 1.0, 3.0)]
    assert {r.country for r in E.country_boxes(parts).collect()} == {"AAA", rules.STATELESS, rules.SPECIAL_REGIONS}
    with pytest.raises(ValueError):
        E.country_boxes(parts, ["QQQ"])


def test_filters_reach_the_scan(spark, contribution, tmp_path):
    from editpulse.sources.readers import read_contributions

    contribution({}).write.parquet(str(tmp_path / "raw"))
    rows = E.assign_countries(read_contributions(spark, str(tmp_path / "raw")), E.box_table(spark, [("AAA", 0.0, 0.0, 1.0, 1.0)]))
    execution = rows.select(F.col("user.id"), "country")._jdf.queryExecution()
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    assert "GreaterThanOrEqual(bbox.xmin" in plan and "GreaterThanOrEqual(valid_from" in plan
    scan = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "tags_before" not in scan and "changeset" not in scan
