"""Edge tables of endpoints, bodies, tick rows, reads and queues."""

import json
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import SF, connect, difference
from topicwell.bindings import TOPICS
from topicwell.catalog.batch import QUERIES
from topicwell.catalog.oracle import ORACLE
from topicwell.functions.control import parse_control
from topicwell.functions.endpoints import valid_endpoint
from topicwell.operators import backlog, delivery, offsets, registry, replay, routing, validation
from topicwell.schemas import TICK_TEXT
from tick_maker import generate_ticks
from topicwell.sources import tables, ticks

T0 = datetime(2024, 1, 1)

ENDPOINTS = {
    "localhost:1": True,
    "grpc://h:65535": True,
    "[::1]:50": True,
    "grpc://[::1]:50051": True,
    "h:00080": True,
    "grpcs://h:65536": False,
    "h:0": False,
    "h:123456": False,
    "http://h:1": False,
    "h": False,
    "a_b:1": False,
    "": False,
    " h:1": False,
    "h:1\n": True,
    "h:1\r\n": False,
    "h:\u0661": False,
}


def test_endpoints(spark):
    df = spark.createDataFrame([(a,) for a in [*ENDPOINTS, None]], "a string")
    found = dict(df.select("a", valid_endpoint(F.col("a"))).collect())
    assert found.pop(None) is False
    assert found == ENDPOINTS


BODIES = [
    ('{"address":"h:1","topic":"view"}', "subscribe", "Success"),
    ('{"address":"h:1","topic":"view","more":[1]}', "subscribe", "Success"),
    ('{"address":"h:0","topic":"view"}', "subscribe", "error"),
    ('{"address":"h:1","topic":"view"}', "unsubscribe", "Success"),
    ('{"address":"h:1","topic":"none"}', "subscribe", "error"),
    ('{"topic":"view"}', "subscribe", "exception"),
    ('{"address":"h:1"}', "subscribe", "exception"),
    ("not json", "subscribe", "exception"),
    ("[1]", "subscribe", "exception"),
    ('["address","topic"]', "subscribe", "exception"),
    ('"address topic"', "subscribe", "exception"),
    ("null", "subscribe", "exception"),
    ('{"address":null,"topic":"view"}', "subscribe", "exception"),
    ('{"address":5,"topic":"view"}', "subscribe", "exception"),
    ('{"address":"h:1","topic":5}', "subscribe", "error"),
    ('{"address":"h:1","topic":null}', "subscribe", "error"),
    ('{"address":"h:1","topic":{}}', "subscribe", "exception"),
    ('{"address":"h:1","topic":[1]}', "subscribe", "exception"),
    ('{"address":"bad","topic":{}}', "subscribe", "error"),
    ('{"address":"h:1","topic":"view"}', "other", "exception"),
    ("not json", "other", "exception"),
]


def test_control_bodies(spark):
    rows = [(i, T0 + timedelta(seconds=i), action, body) for i, (body, action, _) in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, action string, body string")
    answers = registry.control_responses(parse_control(df), ["view"]).orderBy("seq").collect()
    assert [r.response for r in answers] == [b[2] for b in BODIES]
    subscribed = registry.subscribers_current(parse_control(df), ["view"])
    assert subscribed.count() == 0
    intervals = registry.subscription_intervals(parse_control(df), ["view"])
    assert [r.address for r in intervals.collect()] == ["h:1", "h:1"]


HEADER = "timestamp,stock,price,volume,bid_price,ask_price,spread\n"
GOOD = "2025-03-27 09:00:00,ABC,123.455,100,123.00,124.00,1.00\n"


def _folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(HEADER + text)
    (tmp_path / "notes.txt").write_text("not a tick file\n")
    return str(tmp_path)


def test_csv_folder(spark, tmp_path):
    path = _folder(tmp_path, x=GOOD * 2, y=GOOD)
    df = ticks.read_ticks_csv(spark, path)
    assert {r.file: r["count"] for r in df.groupBy("file").count().collect()} == {"x.csv": 2, "y.csv": 1}
    row = df.first()
    assert row.timestamp == datetime(2025, 3, 27, 9)
    assert (row.stock_symbol, row.price, row.volume) == ("ABC", Decimal("123.46"), 100)
    assert ticks.read_ticks_csv(spark, f"{path}/x.csv", folder=False).count() == 2


def test_csv_rules(spark, tmp_path):
    lines = {
        "": GOOD,
        "price_missing": GOOD.replace("123.455", ""),
        "price_overflow": GOOD.replace("123.455", "123456789.99"),
        "price_invalid": GOOD.replace("123.455", "cheap"),
        "volume_invalid": GOOD.replace(",100,", ",x,"),
        "stock_symbol_too_long": GOOD.replace("ABC", "ABCDEFGHIJK"),
        "timestamp_invalid": GOOD.replace("2025-03-27", "yesterday"),
    }
    text = ticks.read_ticks_csv(spark, _folder(tmp_path, t="".join(lines.values())), typed=False)
    accepted, rejected = validation.split_valid_ticks(text)
    assert [r.price for r in accepted.collect()] == [Decimal("123.46")]
    assert sorted(r.reason for r in rejected.collect()) == sorted(k for k in lines if k)
    too_big = validation.split_valid_ticks(
        spark.createDataFrame([("2025-03-27 09:00:00", "ABCDEFGHIJ  ", "1", "3000000000", "1", "1", "1")], TICK_TEXT)
    )
    assert too_big[1].first().reason == "volume_invalid"


def test_file_rules(spark):
    rows = [(f, i, f == "b" and i == 1) for f in "abc" for i in range(3)]
    df = spark.createDataFrame(rows, "file string, event_id bigint, bad boolean")

    def files(**options):
        return sorted({r.file for r in validation.file_atomic_accept(df, F.col("bad"), **options).collect()})

    assert files() == ["a", "c"]
    assert files(stop_at_first=True) == ["a"]
    assert validation.file_atomic_accept(df, F.lit(False), stop_at_first=True).count() == 9


def test_append_twice(spark, tmp_path):
    made = generate_ticks(spark, ["ABC", "XYZ", "LMN"], 300, seed=1)
    path = str(tmp_path / "table")
    for _ in range(2):
        tables.append_ticks(made, path)
    table = spark.read.parquet(path)
    assert {r.stock_symbol: r["count"] for r in table.groupBy("stock_symbol").count().collect()} == {
        "ABC": 600,
        "LMN": 600,
        "XYZ": 600,
    }


def test_generated_ticks(spark, small_limits):
    made = generate_ticks(spark, ["ABC", "XYZ"], 3100, seed=7).collect()
    again = generate_ticks(spark, ["ABC", "XYZ"], 3100, seed=7).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))
    for symbol in ("ABC", "XYZ"):
        own = [r for r in made if r.stock_symbol == symbol]
        assert len(own) == 3100
        seconds = {}
        for r in own:
            seconds[r.timestamp] = seconds.get(r.timestamp, 0) + 1
            assert 100 <= r.price <= 200 and 100 <= r.volume <= 10000
            assert Decimal("0.1") <= r.price - r.bid_price <= 1 and Decimal("0.1") <= r.ask_price - r.price <= 1
            assert r.spread == r.ask_price - r.bid_price
        assert max(seconds.values()) <= 30 and len(set(seconds.values())) > 20
        assert max(seconds) - min(seconds) == timedelta(seconds=len(seconds) - 1)


def test_surrogate_ids(spark):
    df = spark.range(1000, numPartitions=7).withColumn("ts", -F.col("id"))
    dense = validation.with_surrogate_id(df.withColumnRenamed("id", "row"), ("ts", "row")).collect()
    assert sorted((r.id, r.row) for r in dense) == [(i + 1, 999 - i) for i in range(1000)]
    sparse = validation.with_surrogate_id(df.withColumnRenamed("id", "row")).collect()
    assert len({r.id for r in sparse}) == 1000


@pytest.fixture(scope="module")
def log(spark):
    df = spark.sql("SELECT 'small' AS topic, id AS offset FROM range(50) UNION ALL SELECT 'big', id FROM range(150)")
    return df.withColumn("event_id", F.col("offset"))


READS = [
    ("small", 0, 50, "ok"),
    ("small", 49, 1, "ok"),
    ("small", 50, 0, "no_data"),
    ("small", 60, 0, "no_data"),
    ("small", -1, 0, "error"),
    ("small", -51, 0, "error"),
    ("big", 50, 100, "ok"),
    ("big", 49, 100, "clamped"),
    ("big", 0, 100, "clamped"),
    ("big", -1, 100, "clamped"),
    ("none", 0, 0, "unknown_topic"),
    ("none", -1, 0, "unknown_topic"),
    ("empty", 0, 0, "no_data"),
]


def test_reads(spark, log):
    for topic, offset, n, _ in READS:
        rows = offsets.read_from_offset(log, topic, offset).collect()
        assert len(rows) == n, (topic, offset)
        if topic == "big":
            assert min(r.offset for r in rows) == 50
    requests = spark.createDataFrame(
        [(i, t, o) for i, (t, o, _, _) in enumerate(READS)], "request_id bigint, topic string, offset bigint"
    )
    registered = spark.createDataFrame([("small",), ("empty",)], "topic string")
    committed = offsets.committed_offsets(log, registered)
    assert {r.topic: r.committed for r in committed.collect()} == {"small": 50, "big": 150, "empty": 0}
    plan = {r.request_id: r.status for r in offsets.resume_plan(requests, committed).collect()}
    assert [plan[i] for i in range(len(READS))] == [r[3] for r in READS]
    found = offsets.read_requests(log, requests).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in found} == {i: r[2] for i, r in enumerate(READS) if r[2]}
    everything = offsets.read_requests(log, requests, horizon=1000).where("topic = 'big'").groupBy("request_id")
    assert sorted(r["count"] for r in everything.count().collect()) == [100, 101, 150]


def test_small_queue(spark):
    def depths(*ops):
        rows = [(i, T0, op) for i, op in enumerate(ops)]
        df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, op string")
        return [(r.depth, r.at_capacity) for r in backlog.queue_depth(df, capacity=3).orderBy("seq").collect()]

    assert depths("read", "read") == [(0, False), (0, False)]
    assert [d for d, _ in depths("write", "read", "read", "write")] == [1, 0, 0, 1]
    assert depths("write", "write", "write") == [(1, False), (2, True), (3, True)]


def test_columnar_payload(spark):
    rows = [(3, None, Decimal("1.50"), T0, None), (1, "x", None, T0, 2.5)]
    kind = "array<struct<id:int,name:string,price:decimal(10,2),ts:timestamp_ntz,v:double>>"
    df = spark.createDataFrame([("t", rows), ("u", [])], f"topic string, rows {kind}")
    found = {r.topic: json.loads(r.payload) for r in delivery.columnar_json(df).collect()}
    assert found["t"] == {
        "id": [3, 1],
        "name": [None, "x"],
        "price": ["1.50", None],
        "ts": ["2024-01-01 00:00:00"] * 2,
        "v": [None, 2.5],
    }
    assert found["u"] == {"id": [], "name": [], "price": [], "ts": [], "v": []}


def _replayed(spark, n, **options):
    rows = [(t, T0 + timedelta(seconds=s), i) for i, (s, t) in enumerate((s, t) for s in range(6) for t in "ab")]
    df = spark.createDataFrame(rows, "topic string, ts timestamp_ntz, event_id bigint")
    return df, replay.Grid(["a", "b"], T0, 1, n, **options)


def test_replay_turns(spark):
    df, grid = _replayed(spark, 8)
    slots = replay.replay_slots(df, grid).orderBy("slot").collect()
    assert [(r.topic, r.n_rows) for r in slots] == [(t, int(i < 6)) for i, t in enumerate("abababab")]
    df, each = _replayed(spark, 11, per_topic=True)
    slots = replay.replay_slots(df, each).orderBy("slot").collect()
    assert [r.n_rows for r in slots] == [1] * 11
    assert [r.t for r in slots] == [T0 + timedelta(seconds=i // 2) for i in range(11)]
    assert replay.replay_rows(df, each).count() == 11


def test_grid_from_the_data(spark, tmp_path):
    """Events in two years, before 1970 and without a time: the grid spans all that have one."""
    times = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-02-29 23:10:00", "2025-03-01 00:00:00", None]
    rows = [(i, t, topic) for i, t in enumerate(times) for topic in TOPICS]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, topic string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    grid = replay.Grid.covering(TOPICS, df, 3600)
    hours = (datetime(2025, 3, 1) - datetime(1969, 12, 31, 23)) // timedelta(hours=1) + 1
    assert (grid.start, grid.n_slots) == (datetime(1969, 12, 31, 23), hours)
    assert replay.replay_slots(df, grid).agg(F.sum("n_rows")).first()[0] == 4  # one topic's turn in each hour
    assert replay.Grid.covering(TOPICS, df.where("false"), 3600).slots(df).count() == 0
    path = str(tmp_path)
    events = spark.read.parquet(f"{SF}/events.parquet").limit(40)
    late = events.withColumn("ts", F.col("ts") + F.expr("interval '400' day"))
    events.unionByName(late).coalesce(1).write.parquet(f"{path}/folder")
    Path(path, "events.parquet").symlink_to(next(Path(path, "folder").glob("part-*.parquet")))
    for name in ("replay_rows", "replay_slots"):
        assert difference(QUERIES[name](spark, path), connect(path), ORACLE[name]) is None


def test_replayed_event_parts(spark):
    rows = [("a", T0 + timedelta(milliseconds=i), i) for i in range(25)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp_ntz, event_id bigint")
    grid = replay.Grid(["a", "b"], T0, 1, 2)
    events = replay.replay_events(df, grid, ["event_id"], part_rows=10).orderBy("slot", "part").collect()
    assert [(r.slot, r.part, len(r.rows)) for r in events] == [(0, 0, 10), (0, 1, 10), (0, 2, 5), (1, 0, 0)]
    assert [x.event_id for r in events for x in r.rows] == list(range(25))
    assert [r.n_parts for r in events] == [3, 3, 3, 1]
    replayed = replay.replay_events(df, grid, ["event_id"], part_rows=10)
    sent = delivery.columnar_json(replayed).orderBy("slot", "part").collect()
    assert [(r.part, r.n_parts) for r in sent] == [(0, 3), (1, 3), (2, 3), (0, 1)]
    assert [i for r in sent for i in json.loads(r.payload)["event_id"]] == list(range(25))


def test_untagged_and_unknown_topics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "event_id bigint, topic string")
    assert routing.drop_untagged(df.withColumn("topic", F.lit(""))).count() == 0
    topics = spark.createDataFrame([("a",), ("a",), ("b",)], "topic string")
    assert [r.event_id for r in routing.drop_untagged(df).orderBy("event_id").collect()] == [1, 3]
    assert [r.event_id for r in routing.route_registered(df, topics).collect()] == [1]
    assert sorted(r.event_id for r in routing.dead_letter(df, topics).collect()) == [2, 3]


def test_undecodable(spark):
    bodies = ['{"a": 1}', "[1, 2]", "3", "{", "", None, '{"a": }']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    good, skipped = routing.skip_undecodable(df)
    assert sorted(r.id for r in good.collect()) == [0, 1, 2]
    assert sorted(r.id for r in skipped.collect()) == [3, 4, 5, 6]
