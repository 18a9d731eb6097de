"""Times the headline queries end to end and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Every query starts from the derived tracking
tables with nothing staged by another query; deriving the entries from lineitem, the bodies of requests and the raw weekly
files is timed once, as ``derive``. Staged tables go to BENCH_STAGING, by default beside this file, and are deleted."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pursuit.session import build_session
from pursuit.staging import clear
from workload import suite, suite_documents
from workload.tracking import tracking

HEADLINES = [
    "angle_check", "player_profile", "normalize_play", "frame_features", "baseline_report", "prediction_report",
    "crossfit_report", "play_table", "player_ratings", "compute_rating", "history_arrays", "scrimmage_frames",
    "game_documents", "prepare_weeks", "request_validation", "gate_publish", "nested_plays", "game_files", "path_at", "incremental_ratings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=os.environ.get("BENCH_STAGING", os.path.join(os.path.dirname(os.path.abspath(__file__)), "spark-warehouse", "bench")))
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    frames = tracking(spark, sf_dir).inp.count()
    if {"request_validation", "prepare_weeks"} & set(names):
        suite_documents.derive(spark, sf_dir)
    times = {}
    derive = round(time.perf_counter() - start, 3)
    for name in names:
        suite_documents.reset(keep_entries=True)
        start = time.perf_counter()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "input_frames": frames, "derive": derive,
    }))
    clear(spark)


if __name__ == "__main__":
    main()
