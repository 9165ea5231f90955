"""Registered queries against their SQL twins, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import TINY

import __spark_entry__ as entry
from check_oracle import compare, connect

SAMPLE = ["events_by_zone", "weather_features", "weather_etl_table", "label_rainfall",
          "entity_percentiles", "scan_tracks_csv", "scan_daily_json", "validate_features",
          "coerce_numeric", "date_parts", "latest_batches", "upsert_latest_wins", "upsert_table",
          "ingest_plan", "matrix_heatwave", "impute_median", "stratified_split", "standardize",
          "roc_auc_ovr", "log_loss_multiclass", "drift_ks", "drift_report", "drift_pvalue_exact",
          "score_log_drift", "ingest_run", "ingest_stream", "weather_features_incremental",
          "drift_report_stream", "scan_tracks_zip", "scan_paged_orders"]


@pytest.fixture(scope="module")
def con():
    return connect(TINY)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    verdict, n = compare(spark, con, name, TINY)
    assert verdict == "ok" and n > 0


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(queries) - set(oracle) - set(entry.LLM_QUERIES) == set()


def test_entry_runs(spark):
    assert {"zone", "heatwaves", "extreme_rainfall"} == set(entry.entry(spark).columns)
