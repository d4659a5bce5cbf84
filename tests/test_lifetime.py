"""The lifetime summary from contributions, against the one from the daily table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from editpulse.operators import daily as D
from editpulse.operators import enrich as E
from editpulse.operators import lifetime as T
from editpulse.operators import summary as U
from editpulse.sources.staging import stage


def _log(contribution):
    """Changesets over several days, durations and editors, repeated rows, and missing users, countries and tags."""
    start = datetime(2020, 1, 1, 12)
    rows = []
    for i in range(160):
        begun = start + timedelta(days=(i * i) % 211)
        rows.append(
            {
                "user": None if i % 23 == 0 else i % 7,
                "osm_id": i,
                "osm_type": ("node", "way", "relation", "other")[i % 4],
                "contrib_type": ("CREATION", "TAG", "GEOMETRY", "", "DELETION", None)[i % 6],
                "valid_from": begun,
                "valid_to": None if i % 5 == 0 else begun + timedelta(hours=i % 3),
                "tags": None if i % 31 == 0 else {"building": "yes", "highway": "x"} if i % 2 else {"amenity": "bank"},
                "tags_before": ({"building": "no"}, None, {})[i % 3],
                "changeset": i % 29,
                "editor": ("JOSM/1", "iD 2", None, "Vespucci")[i % 4],
                "comment": None if i % 11 == 0 else "c" * (i % 9),
                "closed": start + timedelta(minutes=i % 3),
            }
        )
    return contribution(*rows, *rows[:40])


@pytest.mark.parametrize("gathered_rows", [T.GATHERED_ROWS, 26])
def test_lifetime_summary_equals_the_one_from_the_daily_table(spark, contribution, monkeypatch, gathered_rows):
    monkeypatch.setattr(T, "GATHERED_ROWS", gathered_rows)
    monkeypatch.setattr(D, "TASK_ROWS", 50)
    country = F.when(F.col("osm_id") % 13 == 0, None).otherwise(F.concat(F.lit("C"), F.col("osm_id") % 3))
    enriched = E.enrich(_log(contribution).withColumn("country", country))
    wide = stage(D.daily_user_activity(stage(D.daily_inputs(enriched), "in")).select(*D.DAY_KEY, *U.TOTALS), "daily")
    expected = U.categorization_summary(wide)
    found = T.categorization_summary(stage(T.lifetime_inputs(enriched), "in"))
    assert found.columns == expected.columns
    pairs = list(zip(sorted(found.collect(), key=lambda r: r["user_id"]), sorted(expected.collect(), key=lambda r: r["user_id"]), strict=True))
    assert len(pairs) == 7
    for left, right in pairs:
        assert left.asDict() == {k: pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for k, v in right.asDict().items()}


def test_gathered_rows_are_shuffled_once_per_question(spark, contribution):
    enriched = E.enrich(_log(contribution).withColumn("country", E.F.lit("AAA")))
    rows = stage(T.lifetime_inputs(enriched), "in").repartition(3, "user_id")
    for totals in (T.content_totals(rows), T.changeset_totals(rows)):
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def _alike(found, expected):
    pairs = list(zip(sorted(found.collect(), key=lambda r: str(r["user_id"])), sorted(expected.collect(), key=lambda r: str(r["user_id"])), strict=True))
    for left, right in pairs:
        assert left.asDict() == {k: pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for k, v in right.asDict().items()}
    return len(pairs)


def test_first_days_and_totals_equal_those_from_the_daily_table(spark, contribution, monkeypatch):
    """Some users begin too late, some are heavy, some changesets reach beyond the window, and some rows have no user."""
    monkeypatch.setattr(T, "GATHERED_ROWS", 26)
    monkeypatch.setattr(D, "TASK_ROWS", 50)
    log = _log(contribution).withColumn("valid_from", F.expr("CASE WHEN user.id = 3 THEN valid_from + INTERVAL 400 DAYS ELSE valid_from END"))
    country = F.when(F.col("osm_id") % 13 == 0, None).otherwise(F.concat(F.lit("C"), F.col("osm_id") % 3))
    enriched = E.enrich(log.withColumn("country", country))
    inputs = stage(T.lifetime_inputs(enriched), "in")
    wide = stage(D.daily_user_activity(stage(D.daily_inputs(enriched), "in")).select(*D.DAY_KEY, *U.TOTALS), "daily")
    options = {"horizon": 40, "snapshot": "2020-06-01", "milestones": (3, 5), "early": (4, 20)}
    expected = U.prediction_summary(wide, **options)
    found = T.prediction_summary(inputs, **options)
    assert found.columns == expected.columns and _alike(found, expected) == 6
    assert _alike(T.user_totals(inputs), U.user_totals(U.user_country_sums(wide))) == 8
