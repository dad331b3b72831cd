"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query.

Every query runs twice and the second, warm run counts.  Base tables kept between queries are dropped before
each run, so building them is part of the time.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["sig_05_savgol", "sig_13_window_records", "sig_15_interp_at", "geo_08_box_distance", "geo_18_union_then_fill", "geo_23_map_cues",
            "geo_25_tag_actors", "fea_04_actor_features", "fea_12_window_table", "pu_10_ap_auc", "tmp_05_hmm_posterior", "tmp_06_viterbi",
            "tmp_09_episodes", "emb_08_robust_scale", "grf_09_proximity_edges", "grf_12_adjacency", "grf_15_teacher", "evl_03_match_gt",
            "evd_12_evidence", "llm_03_extract_json", "s6_05_prompt_consensus", "kb_11_ingest_predictions", "kb_18_scenario_trace",
            "ret_04_cosine_topk", "ret_09_oversample_topk", "ret_23_evaluate_queries"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("roadsift-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from roadsift.plans import load_all
    from roadsift.plans.fixtures import forget

    queries, _ = load_all()
    names = [n for n in HEADLINE if len(sys.argv) < 2 or any(n.startswith(p) for p in sys.argv[1:])]
    seconds = {}
    for name in names:
        for _ in range(2):
            forget()
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
