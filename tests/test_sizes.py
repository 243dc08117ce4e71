"""Result sizes known beforehand, at two scales."""

import pytest
from pyspark.sql import functions as F

from topicwell.catalog.batch import QUERIES

SIZES = {
    "0.001": {
        "route_registered": 600,
        "dead_letter": 400,
        "point_lookup": 1,
        "replay_slots": 720,
        "replay_rows": 216,
        "flight_batches": 121,
        "subscribers_current": 4,
        "fan_out": 277,
        "undelivered_flights": 35,
        "connect_sessions": 199,
        "read_from_offset": 100,
        "read_requests": 1503,
        "file_atomic_accept": 997,
        "skip_undecodable_skipped": 105,
    },
    "0.01": {
        "route_registered": 5969,
        "replay_rows": 1952,
        "flight_batches": 1196,
        "fan_out": 2480,
        "undelivered_flights": 493,
        "file_atomic_accept": 9835,
    },
}


@pytest.mark.parametrize("sf,name", [(sf, name) for sf in SIZES for name in SIZES[sf]])
def test_size(spark, sf, name):
    assert QUERIES[name](spark, f"/root/testdata/sf{sf}").count() == SIZES[sf][name]


def _counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


@pytest.mark.parametrize("sf", SIZES)
def test_grouped_sizes(spark, sf):
    path = f"/root/testdata/sf{sf}"
    small = sf == "0.001"
    empty = QUERIES["replay_slots"](spark, path).where("n_rows = 0").count()
    assert empty == (534 if small else 52)
    responses = QUERIES["control_responses"](spark, path)
    found = {(r.action, r.response): r["count"] for r in responses.groupBy("action", "response").count().collect()}
    wanted = (79, 120, 101, 100) if small else (741, 1276, 780, 1234)
    kinds = [("subscribe", "Success"), ("subscribe", "error"), ("unsubscribe", "Success"), ("unsubscribe", "error")]
    assert found == dict(zip(kinds, wanted))
    assert _counts(QUERIES["resume_plan"](spark, path), "status") == {
        "clamped": 12,
        "ok": 6,
        "no_data": 6,
        "unknown_topic": 8,
    }
    rejected = _counts(QUERIES["split_valid_ticks_rejected"](spark, path), "reason")
    names = ["stock_symbol_too_long", "price_missing", "volume_invalid", "price_overflow"]
    assert rejected == dict(zip(names, (14, 9, 10, 12) if small else (93, 111, 99, 97)))
    volume = QUERIES["topic_volume"](spark, path).groupBy("topic").agg(F.max("start_byte")).collect()
    last = (2691, 2587, 2416) if small else (25836, 25552, 25562)
    assert dict(volume) == dict(zip(("click", "purchase", "view"), last))
    depth = QUERIES["queue_depth"](spark, path).agg(F.count("*"), F.max("depth"), F.max_by("depth", "seq")).first()
    assert tuple(depth) == ((398, 34, 29) if small else (3988, 79, 42))
    used = QUERIES["byte_backlog"](spark, path).agg(F.max("bytes_used"), F.max_by("bytes_used", "seq")).first()
    assert tuple(used) == ((302, 257) if small else (705, 377))
    deliveries = QUERIES["fan_out"](spark, path).agg(F.sum("n")).first()[0]
    assert deliveries == (1381 if small else 12380)
