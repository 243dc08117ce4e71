"""Folded results against the step-by-step model on random logs."""

import random
from datetime import datetime, timedelta

import pytest
from compare import limits
from pyspark.sql import functions as F

import model
from topicwell.operators import backlog, delivery, registry

T0 = datetime(2024, 1, 1)
TOPICS = ["a", "b", "c"]
ADDRESSES = ["h1:1", "grpc://h2:2", "[::1]:3", "h4:0", "bad"]
LIMITS = pytest.mark.parametrize("limit", [(100_000, 10_000), (40, 10)], ids=["plain", "divided"])


def _control(seed, n=400):
    random.seed(seed)
    rows, at = [], 0
    for seq in range(n):
        at += random.choice([0, 1, 1, 2])
        action = random.choices(["subscribe", "unsubscribe", "add_topic", "remove_topic", "other"], [60, 20, 6, 6, 2])[0]
        topic = random.choices([*TOPICS, "unknown"], [70, 10, 10, 5])[0]
        client = action not in ("add_topic", "remove_topic")
        address = random.choices(ADDRESSES, [50, 20, 10, 5, 5])[0] if client else None
        rows.append({"seq": seq, "ts": T0 + timedelta(seconds=at), "action": action, "topic": topic, "address": address})
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, action string, topic string, address string")


@pytest.mark.parametrize("seed,limit", [(1, (100_000, 10_000)), (2, (40, 10))], ids=["plain", "divided"])
def test_registry(spark, seed, limit):
    rows = _control(seed)
    events = [(random.choice(TOPICS), T0 + timedelta(seconds=i // 2), i) for i in range(600)]
    wanted_flights = model.flights(events, 5)
    points = [(t, f, ts) for t, f, ts, _ in wanted_flights]
    answers, members, delivered = model.replay_control(rows, ["a", "b"], points)
    control = _frame(spark, rows)
    e = spark.createDataFrame(events, "topic string, ts timestamp_ntz, event_id bigint")
    with limits(spark, *limit):
        found = {r.seq: r.response for r in registry.control_responses(control, ["a", "b"]).collect()}
        assert found == answers
        topics = {r.topic for r in registry.topics_current(control, ["a", "b"]).collect()}
        assert topics == set(members)
        now = sorted(tuple(r) for r in registry.subscribers_current(control, ["a", "b"]).collect())
        assert now == sorted((t, a) for t, m in members.items() for a in m)
        intervals = registry.subscription_intervals(control, ["a", "b"])
        still = intervals.where(F.year("valid_to") == 9999).select("topic", "address")
        assert sorted(tuple(r) for r in still.collect()) == now
        batches = delivery.flight_batches(e)
        assert sorted((r.topic, r.flight, r.fts, r.n) for r in batches.collect()) == sorted(wanted_flights)
        sent = delivery.fan_out(batches, intervals).select("topic", "flight", "address")
        assert sorted(tuple(r) for r in sent.collect()) == sorted(delivered)
        lost = delivery.undelivered_flights(batches, intervals).select("topic", "flight")
        assert {tuple(r) for r in lost.collect()} == {p[:2] for p in points} - {d[:2] for d in delivered}


@LIMITS
def test_prune_failed(spark, limit):
    random.seed(5)
    rows = [("t", f, f"a{a}", random.random() < 0.05) for f in range(60) for a in range(6)]
    dropped, wanted = set(), []
    for topic, flight, address, failed in rows:
        if address not in dropped:
            wanted.append((topic, flight, address))
        if failed:
            dropped.add(address)
    df = spark.createDataFrame(rows, "topic string, flight bigint, address string, failed boolean")
    with limits(spark, *limit):
        kept = delivery.prune_failed(df, F.col("failed")).select("topic", "flight", "address")
        assert sorted(tuple(r) for r in kept.collect()) == sorted(wanted)


@LIMITS
@pytest.mark.parametrize("writes", [0.3, 0.6])
def test_queue(spark, writes, limit):
    random.seed(9)
    ops = [("write" if random.random() < writes else "read", random.randrange(1, 50)) for _ in range(500)]
    rows = [(i, T0 + timedelta(seconds=i // 3), op, size) for i, (op, size) in enumerate(ops)]
    wanted = model.queue(ops)
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, op string, size int").repartition(3)
    with limits(spark, *limit):
        depth = {r.seq: r.depth for r in backlog.queue_depth(df, 1000).collect()}
        used = {r.seq: r.bytes_used for r in backlog.byte_backlog(df, F.col("size"), 1000).collect()}
    assert [depth[i] for i in range(len(ops))] == [d for d, _ in wanted]
    assert [used[i] for i in range(len(ops))] == [b for _, b in wanted]


def test_connect_sessions(spark):
    random.seed(11)
    rows = [
        {
            "seq": i,
            "ts": T0 + timedelta(seconds=i),
            "action": random.choice(["connect", "connect", "disconnect"]),
            "topic": random.choice(TOPICS),
            "address": f"viewer{random.randrange(4)}",
        }
        for i in range(200)
    ]
    points = [(t, i, T0 + timedelta(seconds=i, milliseconds=500)) for i in range(200) for t in TOPICS]
    steps = []
    for r in rows:
        if r["action"] == "connect":
            steps.append({**r, "seq": r["seq"] * 2, "action": "add_topic"})
            steps.append({**r, "seq": r["seq"] * 2 + 1, "action": "subscribe"})
        else:
            steps.append({**r, "seq": r["seq"] * 2, "action": "unsubscribe"})
    _, _, delivered = model.replay_control(steps, [], points, check=False)
    p = spark.createDataFrame(points, "topic string, flight bigint, fts timestamp_ntz")
    sent = delivery.fan_out(p, registry.connect_sessions(_frame(spark, rows)))
    assert sorted(tuple(r) for r in sent.select("topic", "flight", "address").collect()) == sorted(delivered)


def test_registry_edges(spark):
    def run(*steps):
        rows = [
            {"seq": i, "ts": T0 + timedelta(seconds=i), "action": a, "topic": "t", "address": who}
            for i, (a, who) in enumerate(steps)
        ]
        control = _frame(spark, rows)
        now = sorted(r.address for r in registry.subscribers_current(control, ["t"]).collect())
        answers = [r.response for r in registry.control_responses(control, ["t"]).orderBy("seq").collect()]
        return now, answers

    add, remove = ("add_topic", None), ("remove_topic", None)
    sub, unsub = ("subscribe", "h:1"), ("unsubscribe", "h:1")
    assert run(sub, add) == ([], ["Success"])
    assert run(remove, sub) == ([], ["error"])
    assert run(remove, add, sub) == (["h:1"], ["Success"])
    assert run(sub, sub, unsub) == ([], ["Success"] * 3)
    assert run(unsub) == ([], ["Success"])


@LIMITS
def test_subscriber_list_pages(spark, limit):
    rows = [
        {"seq": i, "ts": T0 + timedelta(seconds=i), "action": "subscribe", "topic": "t", "address": f"h{i}:1"}
        for i in range(25)
    ]
    asked = spark.createDataFrame([("nowhere",)], "topic string")
    with limits(spark, *limit):
        lists = registry.subscriber_lists(_frame(spark, rows), ["t", "idle"], asked, page_rows=10).collect()
    of = {(r.topic, r.page): r for r in lists}
    assert {k: r.n for k, r in of.items()} == {("t", 0): 10, ("t", 1): 10, ("t", 2): 5, ("idle", 0): 0, ("nowhere", 0): 0}
    assert sorted(a for r in lists for a in r.addresses) == sorted(f"h{i}:1" for i in range(25))
    in_order = [a for page in range(3) for a in of[("t", page)].addresses]
    assert in_order == sorted(f"h{i}:1" for i in range(25))
    assert {(r.topic, r.n_total, r.n_pages) for r in lists} == {("t", 25, 3), ("idle", 0, 1), ("nowhere", 0, 1)}
