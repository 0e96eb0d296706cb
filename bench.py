"""Time all queries of the library and print one JSON line.

``BENCH_SF_DIR`` names the folder of test tables, ``BENCH_CPUS`` the number of
cores. Each query is run to its last row, without bringing rows to the driver.
Tables that several reports share are written first; that is part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.plans import queries  # noqa: E402
from tidewire.session import build_session  # noqa: E402
from tidewire.sources import fixtures  # noqa: E402

#: The queries of the first round, whose total is kept for comparison.
HEADLINES = [
    "route_counts",
    "header_lookup",
    "decode_permissive",
    "generated_records",
    "ingest_valid",
    "registry_fanout",
    "resume_no_dup",
    "stream_dedup",
    "dlq_recent",
    "counts_by_type",
    "dlq_by_reason",
    "all_events_view",
    "dlq_replay",
    "partition_prune",
    "dedup_events",
    "cow_upsert",
    "cow_delete",
    "consumer_lag",
    "metric_sum",
    "metric_sum_by",
    "metric_rate",
    "metric_increase",
    "metric_irate",
    "metric_delta",
    "metric_range",
    "label_values",
    "dashboard_exporter",
    "dashboard_broker",
    "dashboard_operators",
    "jmx_normalize",
    "relabel",
    "log_lines",
    "log_multiline",
    "log_merge",
    "log_enriched",
]


def timed(work) -> float:
    begin = time.perf_counter()
    work()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    records = fixtures.events(spark, sf_dir).count()
    setup = {
        **{f"tables_{k}": timed(lambda k=k: queries.lake(spark, sf_dir, k)) for k in ("faulty", "types")},
        **{
            f"samples_{b}": timed(lambda b=b: queries._scraped(spark, sf_dir, b))
            for b in ("exporter", "broker", "operators")
        },
    }

    def run(name: str) -> None:
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {name: timed(lambda name=name: run(name)) for name in queries.QUERIES}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()) + sum(setup.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "setup": setup,
                "headline_seconds": round(sum(seconds[name] for name in HEADLINES), 3),
                "ingest_records_per_sec": round(records / seconds["ingest_valid"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
