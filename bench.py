"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["polish_full", "fill_stop_day_horizon", "clip_overlaps", "concat_strategy", "channel_registry", "pool_same_instant", "fuse_union_titles", "band_match_pairs", "nearest_match", "greedy_fold_guide", "stale_grid", "request_plan_both", "date_format", "date_parse", "escape_text", "title_key", "episode_numbers", "programme_xml", "xml_roundtrip", "star_priority_join"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from guide_engine.catalogue import QUERIES

    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("polish_full")  # start-up isn't counted
    times = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
