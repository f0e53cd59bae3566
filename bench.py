"""Seconds of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tracelake.session import session

HEADLINES = ("spike_features", "car_median", "channel_neighbours", "fronts", "saturation_intervals", "spikes_venn3", "extract_waveforms", "wfs_table", "destripe_car", "cadzow", "sync_extract", "dft")


def main() -> None:
    at = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    began = time.perf_counter()
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter() - began
    from tracelake import registry

    found = {}
    for name in HEADLINES:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        found[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline queries, median of 3, warm", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(at.rstrip("/")), "startup_sec": round(start, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
