"""Registered queries against their SQL twins. ``ALL_QUERIES=1`` runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tabularium import catalog
from tabularium.session import TABLES
from tools.check import normal

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = (
    "univariate_outlier_summary", "class_statistics", "exact_duplicates", "near_duplicates", "global_split", "repeated_folds", "curriculum_metadata",
    "balanced_feature_ranking", "neighbour_information", "local_outlier_factor", "silhouette_samples", "label_metrics", "early_stops_with_delta",
    "epoch_diagnostics", "dispatcher_status", "worker_signals", "silence_events", "heartbeat_fold", "task_states", "checkpoint_slots",
    "stage_reset", "natural_manifests", "subset_index", "subset_distribution", "final_manifest_fallback", "isolation_flag_counts", "two_feature_reconstruction",
    "two_feature_loadings", "two_class_discriminant", "three_feature_pruning", "binned_information", "feature_correlations", "bootstrap_resamples", "average_ranks",
    "streamed_heartbeats", "streamed_silence_events", "streamed_task_states", "streamed_early_stops", "identifiers", "incremental_extraction",
)
NAMES = sorted(catalog.QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    assert normal(got) == normal([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
