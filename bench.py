"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "Q0_mosaic_accuracy", "AGG01_quantiles", "AGG03_argmax_class", "AGG06_plurality", "AGG12_pixel_accuracy", "AGG14_histogram", "PRJ07_quantile_stretch",
    "JON10_align_truth", "JON11_cover_tiles", "JON17_fill_nearest", "FLT10_intersects", "FLT02_blank_tiles", "WIN01_widest_gap", "WIN02_rle_encode", "AGG31_components", "UDF05_colour_correction",
)


def main() -> None:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pixelweave.plans.all import QUERIES
    from pixelweave.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["AGG05_vote_counts"](spark, sf).count()  # starts the JVM's compilers and Python workers
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
