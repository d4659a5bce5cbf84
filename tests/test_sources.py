from pathlib import Path

from editpulse.operators.summary import TOTALS
from editpulse.plans import pipeline
from editpulse.sources import readers, staging, writers


def boundaries(spark):
    return spark.createDataFrame(
        [("AAA", -10.0, -10.0, 10.0, 10.0), ("BBB", -10.0, -10.0, 10.0, 10.0)],
        "iso string, xmin double, ymin double, xmax double, ymax double",
    )


def test_raw_files_to_summaries(spark, contribution, tmp_path):
    contribution({"countries": ["AAA", "BBB"]}, {"user": 2, "countries": []}).write.parquet(str(tmp_path / "raw" / "part1"))
    contribution({"user": 3, "countries": ["BBB"]}).write.parquet(str(tmp_path / "raw" / "part2"))
    raw = readers.read_contributions(spark, str(tmp_path / "raw" / "*" / "*.parquet"))
    assert raw.count() == 3
    pipeline.build_daily_activity(raw, boundaries(spark), str(tmp_path / "daily"))
    folders = {p.name for p in (tmp_path / "daily").iterdir() if p.is_dir()}
    assert folders == {"country=AAA", "country=BBB", "country=STATELESS"}
    daily = readers.read_daily_activity(spark, str(tmp_path / "daily"))
    assert daily.count() == 4 and set(TOTALS) <= set(daily.columns) and len(daily.columns) == 152
    paths = [str(tmp_path / name) for name in ("daily", "pred", "cat")]
    pipeline.build_user_summaries(spark, *paths)
    predicted, grouped = (readers.read_user_summary(spark, path) for path in paths[1:])
    assert [r["user_id"] for r in predicted.orderBy("user_id").collect()] == [1, 2, 3]
    assert len(grouped.columns) == 67
    assert any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "pred").iterdir())


def test_boundary_reader(spark, tmp_path):
    boundaries(spark).write.parquet(str(tmp_path / "b"))
    assert readers.read_boundaries(spark, str(tmp_path / "b")).count() == 2


def test_metric_and_assignment_sinks(spark, tmp_path):
    metrics = spark.createDataFrame([(2, 0.5), (3, 0.25)], "k int, silhouette double")
    writers.write_metrics_csv(metrics, str(tmp_path / "m"))
    (file,) = (tmp_path / "m").glob("*.csv")
    assert file.read_text().splitlines() == ["k,silhouette", "2,0.5", "3,0.25"]
    writers.write_assignments(metrics, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_named_table(spark):
    with staging.named_table(spark.range(5), "five") as table:
        assert spark.sql("SELECT sum(id) FROM five").first()[0] == 10 and table.count() == 5
    assert not spark.catalog.tableExists("five")


def test_staging_folder_comes_from_the_session(spark):
    root = spark.conf.get(staging.CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    staged = staging.stage(spark.range(3), "x")
    assert all(root.removeprefix("file:") in name for name in staged.inputFiles())


def test_staged_tables_are_dropped(spark):
    staged = staging.stage(spark.range(3), "dropped")
    (file, *_) = staged.inputFiles()
    assert staged.count() == 3
    staging.drop_staged(spark)
    assert not Path(file.removeprefix("file://")).exists()


def test_jobs_delete_their_own_tables_only(spark):
    outside = staging.stage(spark.range(3), "outside")
    with staging.job_tables(spark):
        mine = staging.stage(spark.range(4), "mine")
        with staging.job_tables(spark):
            inner = staging.stage(spark.range(5), "inner")
            assert inner.count() == 5
        assert mine.count() == 4 and not Path(inner.inputFiles()[0].removeprefix("file://")).exists()
        files = mine.inputFiles()
    assert outside.count() == 3 and not any(Path(f.removeprefix("file://")).exists() for f in files)


def test_later_countries_leave_earlier_ones(spark, contribution, tmp_path):
    rows = contribution({"countries": ["AAA", "BBB"]}, {"user": 2, "countries": ["BBB"]})
    for code in ("AAA", "BBB", "BBB"):
        pipeline.build_daily_activity(rows, boundaries(spark), str(tmp_path / "daily"), codes=[code])
    daily = readers.read_daily_activity(spark, str(tmp_path / "daily"))
    assert sorted((r["country"], r["user_id"]) for r in daily.collect()) == [("AAA", 1), ("BBB", 1), ("BBB", 2)]


def test_options_reach_both_summaries(spark, contribution, tmp_path):
    pipeline.build_daily_activity(contribution({}), boundaries(spark), str(tmp_path / "d"), weighted_validity=True)
    paths = [str(tmp_path / name) for name in ("d", "p", "c")]
    pipeline.build_user_summaries(spark, *paths, milestones=(5,))
    assert all("days_to_5" in readers.read_user_summary(spark, path).columns for path in paths[1:])
