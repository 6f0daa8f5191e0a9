"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldshift.catalog import QUERIES  # noqa: E402
from fieldshift.session import local_session, release, ship  # noqa: E402

HEADLINE = (
    "unit_panel element_panel period_entropy period_novelty panel_lags momentum_test season_windows period_index "
    "forecast_shift weekly_anchor_matrix fc_glide fc_stoch_vol horse_race best_next_forecast ensemble_uncertainty "
    "context_sets parse_packed parse_export extract_rosters extract_pairings dedupe_rosters duplicate_row_keys "
    "attribute_tokens masked_examples member_options assign_codebook representatives_current knn_exact "
    "expected_winrate advantage_matrix rate_rosters pairing_metrics recommend_completions stream_forecast_refresh"
).split()


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    release(spark)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fieldshift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.read.parquet(f"{sf}/orders.parquet").count()
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
