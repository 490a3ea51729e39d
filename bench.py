"""Headline queries on one machine: prints one JSON line."""
import json
import os
import time

from marketlens.session import local_session

QUERIES = (
    "agg1_daily_sales_by_product", "src5_gold_fact_sales", "joi2_star_join", "joi6_asof_last_before", "joi8_count_before", "joi9_client_history_asof",
    "joi16_cooccurrence", "agg7_order_baskets", "agg12_classify_demand", "agg15_commerce_kpis", "win1_session_sequences", "win3_sessionize", "win6_rolling_features",
    "win7_cutoff_features", "win11_stock_features", "top3_rerank_diversity", "dq22_final_build_checks", "for1_naive_family", "for3_croston_level",
    "for4_tsb_level", "for5_ets_damped", "pri12_discount_scenario_grid", "pri15_campaign_episodes", "rec1_popularity_global", "rec2_item_item_cosine", "rec8_complement_scores", "eva8_ranking_metrics",
    "eva18_bucket_intervals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = local_session(cpus)
    from marketlens.catalog import load
    registry = load().QUERIES
    registry["agg1_daily_sales_by_product"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in only or QUERIES:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
