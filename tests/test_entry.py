import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from riskloom import scratch

FAST = [
    "dataset_summary", "integrity_check", "time_features", "build_uid", "temporal_split_summary", "inner_split_summary", "entity_frame", "hub_suppressed_edges", "coverage_by_cap", "graph_features",
    "average_precision", "value_weighted_ap", "roc_auc", "pr_curve", "threshold_by_cost", "threshold_under_cap", "threshold_sweep", "calibration_report", "psi_by_feature", "drift_windows", "value_concentration",
    "cost_weights_summary", "bootstrap_vdr_delta_hash", "bootstrap_ap_delta_hash", "ring_observed", "cluster_evidence", "case_findings", "event_dedup", "live_entities", "payer_extract", "extract_numbers",
    "narrative_validation", "indian_grouping", "to_paise",
    "connected_components", "k_core", "pagerank", "train_test_graph_features", "component_subgraph", "case_files", "case_by_id", "operating_points", "summary_lines", "evaluation_report", "drift_report",
    "ranking_quality_trend", "metric_intervals", "pluggable_metric", "ring_permutation_hash", "homophily_permutation_hash", "event_count", "audit_trail", "health", "analysis_by_id", "all_payments",
    "signature_check", "disposition_validation", "drafted_dispositions", "feature_names", "incremental_core_replay",
    "features_by_cap", "cap_metrics", "entity_index", "recorded_decisions", "live_attributes", "live_batches", "drafted_narratives", "bootstrap_value_ap_delta_hash", "value_comparison", "delivery_verdicts",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, duck, name):
    df = driver.queries()[name](spark, sf)
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_scratch_tables_can_be_removed(spark, tmp_path):
    s = scratch.Scratch(spark, "gone")
    s.table(spark.range(3), "t")
    at = s.base.removeprefix("file://")
    assert os.path.isdir(at)
    scratch.clean(spark)
    assert not os.path.isdir(at) and not scratch.made
