"""Registered queries against their SQL. A sample by default, all of them with ORACLE_ALL=1."""
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from marketlens.catalog import load  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
REG = load()
SAMPLE = ["src3_bronze", "src4_silver_gate", "sch5_resolve_scopes", "fil7_filter_sales", "joi5_campaign_overlap_count", "joi6_asof_last_before", "joi8_count_before",
          "joi9_client_history_asof", "joi16_cooccurrence", "agg7_order_baskets", "agg12_classify_demand", "agg15_commerce_kpis", "win1_session_sequences", "win3_sessionize",
          "win11_stock_features", "win20_abc_class", "top2_rank_with_fallback", "top3_rerank_diversity", "dq4_duplicates", "dq26_exposure_checks", "for1_naive_family",
          "for13_expanding_ensemble", "pri4_descriptive_predictor", "rec8_complement_scores", "eva8_ranking_metrics", "eva16_conformal_quantile"]
NAMES = sorted(REG.ORACLES) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    message, _ = compare(REG.QUERIES[name](spark, SF), con, REG.ORACLES[name])
    assert message == "", message


def test_every_oracle_has_a_query():
    assert set(REG.ORACLES) <= set(REG.QUERIES)
