"""Time the headline queries and print one JSON line.

Every query is run to the end with the ``noop`` sink, once untimed and then timed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from topicwell.catalog import batch
from topicwell.operators.validation import scan_fetch as fetch_all
from topicwell.session import build_session

HEADLINE = [
    "scan_count",
    "scan_fetch",
    "point_lookup",
    "route_registered",
    "replay_slots",
    "replay_rows",
    "subscription_intervals",
    "flight_batches",
    "fan_out",
    "undelivered_flights",
    "assign_offsets",
    "read_from_offset",
    "read_requests",
    "topic_volume",
    "queue_depth",
    "byte_backlog",
]


def scan_fetch(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**batch.QUERIES, "scan_fetch": scan_fetch}

    def run(name: str) -> float:
        start = time.perf_counter()
        fetch_all(queries[name](spark, sf_dir))
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "event_rows": rows,
                "scan_fetch_rows_per_sec": round(rows / seconds["scan_fetch"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
