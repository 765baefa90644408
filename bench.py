"""Headline reports on the given tables; prints one JSON line.

The ledger-shaped tables are derived once and stored, dated tables partitioned by their
date, as a warehouse would hold them (``setup_sec``). Each report then reads the stored
tables and writes its whole result to Spark's ``noop`` sink; of two passes over all reports the better time counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import cases_operators, cases_reports  # noqa: E402
from checks.fixtures import Tables, store  # noqa: E402
from tallybook.session import apply_runtime_conf, scratch_folder  # noqa: E402

DATA = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
OPERATORS = ("match_classify", "polymorphic_or_join", "priority_match", "recovery_population", "id_list_filter")
PASSES = 2
DATABASE = "bench"


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallybook-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    started = time.perf_counter()
    store(spark, DATA, DATABASE, scratch_folder(spark))
    setup = time.perf_counter() - started

    cases = {k: cases_operators.CASES[k] for k in OPERATORS} | cases_reports.CASES
    times = dict.fromkeys(cases, float("inf"))
    for _ in range(PASSES):
        for key, (run, _) in cases.items():
            started = time.perf_counter()
            run(Tables(spark, DATA, DATABASE)).write.format("noop").mode("overwrite").save()
            times[key] = min(times[key], round(time.perf_counter() - started, 3))
    print(
        json.dumps(
            {
                "metric": "reports_total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(DATA.rstrip("/")).removeprefix("sf"),
                "setup_sec": round(setup, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
