"""Registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duckdb_views

SMALL = "/root/testdata/sf0.001"

# One query per operator family; `python -m checks.compare` runs all of them.
CHECKED = [
    "bbox_country_assignment", "key_diff", "added_key_categories", "feature_flags", "daily_user_activity", "observation_window",
    "top_feature_type", "prediction_summary", "categorization_summary", "stratified_split", "mutual_information", "scaled_features", "daily_changeset_stats", "distinct_days", "daily_table_on_disk",
    "user_sample", "frequency_encoding", "class_weights", "silhouette_sampled", "silhouette_squared", "pca_total_variance",
    "classification_report", "pr_threshold_curve", "silhouette_exact", "elbow_choice",
    "linear_gradient", "stratified_folds", "kmeans_step", "mixture_step", "pca_covariance", "boundary_envelopes",
]


@pytest.fixture(scope="module")
def oracle():
    return duckdb_views(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_duckdb(spark, oracle, name):
    frame = entry.queries()[name](spark, SMALL)
    rows = [tuple(row) for row in frame.collect()]
    expected = oracle.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert difference(frame.columns, rows, expected) is None


@pytest.mark.parametrize("name", ["linear_retention", "linear_retention_lifetime", "kmeans_assign", "gmm_assign"])
def test_models_run_on_the_registered_tables(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 64


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_entry_without_a_library_of_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    root = entry.__file__.rsplit("/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 84 and out[1] == "False"
