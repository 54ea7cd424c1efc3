"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the local cores. Every result row is produced (noop sink).
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pitscreen.catalog import QUERIES  # noqa: E402
from pitscreen.session import get_session  # noqa: E402

HEADLINE = [
    "scr_08_recovery_composite", "scr_09_entry_composite", "ind_05_rsi", "evt_04_fixed_hold", "evt_07_forward_drawdown", "evt_12_local_minimum",
    "evt_16_min_gap", "fnd_06_snapshot_asof", "uni_06_top_n", "vet_02_veto", "ext_06_variant_metrics", "agg_01_bucket_stats",
    "agg_08_band_sensitivity", "agg_11_factor_reliability", "agg_17_curve_metrics", "agg_32_oos_audit", "job_01_daily_screen",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", int(cpus) * 2, **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
