"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridreach.plans import all_queries
from gridreach.plans.world import World
from gridreach.session import local_session, scratch_scope

HEADLINE = [
    "f1_poi_features", "c12_overlay_length", "c13_overlay_three_way", "c14_count_within_radius", "e1_nearest_stop", "e2_anchor_nodes", "e4_dedup_near_ways",
    "f5_bus_departures", "f9_allocate_mass", "f18_quantiles", "g1_pct_rank_min", "g2_pct_rank_avg", "i2_reach_15min", "i6_category_access", "i7_system_access", "i9_components",
    "i20_morans_i", "j3_horn_slope", "k1_spearman_matrix", "l7_ari_nmi", "m1_dimension_scores", "m9_cell_stability", "n13b_intervention", "n20_case_studies", "x1_stream_hourly_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gridreach-bench")
    spark.sparkContext.setLogLevel("OFF")
    every, times = all_queries(), {}
    every["f1_poi_features"].build(World(spark, sf_dir)).write.format("noop").mode("overwrite").save()  # start-up cost is not a query
    for name in HEADLINE:
        t = time.time()
        with scratch_scope(spark):
            every[name].build(World(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
