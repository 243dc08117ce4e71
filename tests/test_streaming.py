"""Streaming forms against their batch operators, over several files and restarts."""

import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import SF
from topicwell import bindings as b
from topicwell.operators import delivery, offsets, registry, routing, validation
from topicwell.schemas import TICK_TEXT
from tick_maker import generate_ticks
from topicwell.streaming import batches, intake, topics
from topicwell.streaming.batches import SNAPSHOT, commit_batch, last_batch, next_numbers

T0 = datetime(2025, 1, 1)
EVENT = ["event_id", "ts", "topic"]


@pytest.fixture
def parts(spark, tmp_path):
    """The events in four files in time order, to be moved into ``folder`` step by step."""
    events = b.tagged(spark, SF).drop("k")
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    piece = sum((F.when(F.col("event_id") > q, 1).otherwise(0) for q in bounds), F.lit(0))

    def add(*numbers):
        for n in numbers:
            events.where(piece == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add.events = events
    add.piece = piece
    add.source = lambda: intake.stream_parquet(spark, str(tmp_path / "in"), events.schema, max_files=1)
    add.table, add.checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    return add


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def _repeat_last_batch(checkpoint):
    """Forget that the last batch was finished, as if the run had been lost there."""
    done = [p for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit()]
    last = max(done, key=lambda p: int(p.name))
    last.unlink()
    Path(checkpoint, "commits", f".{last.name}.crc").unlink(missing_ok=True)


def test_offsets_over_batches_and_restarts(spark, parts):
    parts(0, 1)
    run = lambda: topics.stream_assign_offsets(parts.source(), parts.table, parts.checkpoint)
    run()
    halfway = topics.read_log(spark, parts.table).count()
    _repeat_last_batch(parts.checkpoint)
    parts(2, 3)
    run()
    log = topics.read_log(spark, parts.table)
    assert 0 < halfway < log.count()
    assert spark.read.parquet(f"{parts.table}/commits").select("batch_id").distinct().count() == 4
    wanted = offsets.assign_offsets(parts.events)
    assert _rows(log) == _rows(wanted)
    tail = topics.stream_read_from_offset(spark, parts.table, "view", 4)
    assert _rows(tail) == _rows(offsets.read_from_offset(wanted, "view", 4))


def test_offsets_with_divided_topics(spark, parts, small_limits):
    parts(0, 1, 2, 3)
    topics.stream_assign_offsets(parts.source(), parts.table, parts.checkpoint)
    assert _rows(topics.read_log(spark, parts.table)) == _rows(offsets.assign_offsets(parts.events))


def test_events_without_topic_get_no_offset(spark, parts):
    parts(0)
    source = parts.source().withColumn("topic", F.when(F.col("topic") != "view", F.col("topic")))
    topics.stream_assign_offsets(source, parts.table, parts.checkpoint)
    wanted = parts.events.where((parts.piece == 0) & (F.col("topic") != "view"))
    assert topics.read_log(spark, parts.table).count() == wanted.count()


def test_route(spark, parts):
    parts(0, 1)
    run = lambda: topics.stream_route(
        parts.source().select(*EVENT), b.topics(spark), parts.table, parts.checkpoint
    )
    run()
    _repeat_last_batch(parts.checkpoint)
    parts(2, 3)
    run()
    events = parts.events.select(*EVENT)
    routed = topics.read_routed(spark, parts.table, topics.ROUTED)
    assert _rows(routed) == _rows(routing.route_registered(events, b.topics(spark)))
    lost = topics.read_routed(spark, parts.table, topics.DEAD_LETTER)
    assert _rows(lost) == _rows(routing.dead_letter(events, b.topics(spark)))


def test_subscribers(spark, parts):
    run = lambda: topics.stream_subscribers(
        b.control_of(parts.source().withColumn("k", b.number())), parts.table, parts.checkpoint
    )
    so_far = []
    for step in ([0, 1], [2, 3]):
        parts(*step)
        run()
        so_far += step
        control = b.control_of(parts.events.where(parts.piece.isin(so_far)).withColumn("k", b.number()))
        wanted = registry.subscribers_current(control, b.TOPICS)
        assert _rows(topics.read_subscribers(spark, parts.table, b.TOPICS)) == _rows(wanted)


def test_fan_out_per_batch(spark, parts):
    parts(0, 1, 2, 3)
    intervals = registry.subscription_intervals(b.control(spark, SF), b.TOPICS)
    source = parts.source().where(F.col("topic").isin(b.TOPICS)).select(*EVENT)
    topics.stream_fan_out(source, intervals, parts.table, parts.checkpoint)
    _repeat_last_batch(parts.checkpoint)
    topics.stream_fan_out(source, intervals, parts.table, parts.checkpoint)
    # A batch is a drain: chunks of five per piece, numbered on over the pieces.
    rows = parts.events.where(F.col("topic").isin(b.TOPICS)).withColumn("piece", parts.piece)
    place = F.row_number().over(Window.partitionBy("topic", "piece").orderBy("ts", "event_id")) - 1
    chunks = (
        rows.withColumn("chunk", F.floor(place / 5))
        .groupBy("topic", "piece", "chunk")
        .agg(F.count("*").alias("n"), F.max("ts").alias("fts"))
    )
    number = F.row_number().over(Window.partitionBy("topic").orderBy("piece", "chunk")) - 1
    flights = chunks.withColumn("flight", number.cast("bigint"))
    wanted = delivery.fan_out(flights, intervals).select("topic", "flight", "address", "n")
    found = topics.read_deliveries(spark, parts.table)
    assert _rows(found.select("topic", "flight", "address", "n")) == _rows(wanted)
    one = topics.read_deliveries(spark, parts.table, "grpc://u1:8000")
    assert _rows(one.select("topic", "flight", "address", "n")) == _rows(wanted.where("address = 'grpc://u1:8000'"))


def test_topic_tap(spark, parts):
    parts(0, 1, 2, 3)
    topics.stream_topic_tap(parts.source().select(*EVENT), "view", parts.table, parts.checkpoint)
    wanted = routing.topic_tap(parts.events.select(*EVENT), "view")
    assert _rows(spark.read.parquet(parts.table)) == _rows(wanted)


def test_tick_files(spark, tmp_path):
    made = generate_ticks(spark, ["ABC", "XYZ", "LMN"], 300, seed=3)
    folder, table = str(tmp_path / "csv"), str(tmp_path / "table")
    made.repartitionByRange(4, "timestamp").write.option("header", True).csv(folder)
    source = intake.stream_ticks_csv(spark, folder, max_files=1)
    intake.start_stream(
        source.writeStream.format("parquet").option("path", table), str(tmp_path / "checkpoint")
    )
    found = spark.read.parquet(table)
    assert found.select("file").distinct().count() == 4
    assert _rows(found.drop("file")) == _rows(made)


def test_stream_without_events_reads_as_empty(spark, parts):
    parts(0)
    source = parts.source().withColumn("topic", F.lit(None).cast("string"))
    topics.stream_assign_offsets(source, parts.table, parts.checkpoint)
    log = topics.read_log(spark, parts.table)
    assert log.count() == 0 and set(log.columns) == {*parts.events.columns, "offset"}
    topics.stream_route(source.where("false"), b.topics(spark), parts.table + "2", parts.checkpoint + "2")
    assert topics.read_routed(spark, parts.table + "2", topics.ROUTED).count() == 0


def _wait(done):
    for _ in range(600):
        if done():
            return
        time.sleep(0.1)
    raise AssertionError("the stream did not get there")


def test_topics_and_subscriptions_added_while_the_streams_run(spark, tmp_path):
    """Both streams stay up; the second batch sees the topic and the subscriber added after the first."""
    spark.createDataFrame([("a",)], "topic string").write.parquet(str(tmp_path / "topics"))
    spans = "topic string, address string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    spark.createDataFrame([("a", "h:1", T0, None)], spans).write.parquet(str(tmp_path / "spans"))
    columns = "event_id bigint, ts timestamp_ntz, topic string"

    def send(first):
        rows = [(first + i, T0 + timedelta(seconds=first + i), t) for i, t in enumerate("ab")]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    send(0)
    source = intake.stream_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], columns).schema)
    often = {"processingTime": "200 milliseconds"}
    at = {k: str(tmp_path / k) for k in ("routes", "deliveries", "one", "two")}
    streams = [
        topics.stream_route(source, str(tmp_path / "topics"), at["routes"], at["one"], trigger=often),
        topics.stream_fan_out(source, str(tmp_path / "spans"), at["deliveries"], at["two"], trigger=often),
    ]
    try:
        _wait(lambda: all(last_batch(spark, at[k]) == 0 for k in ("routes", "deliveries")))
        spark.createDataFrame([("b",)], "topic string").write.mode("append").parquet(str(tmp_path / "topics"))
        more = [("b", "h:2", T0, None)]
        spark.createDataFrame(more, spans).write.mode("append").parquet(str(tmp_path / "spans"))
        send(2)
        _wait(lambda: all(last_batch(spark, at[k]) == 1 for k in ("routes", "deliveries")))
        assert all(s.isActive for s in streams)
    finally:
        for s in streams:
            s.stop()
    routed = topics.read_routed(spark, at["routes"], topics.ROUTED)
    assert sorted(r.event_id for r in routed.collect()) == [0, 2, 3]
    sent = topics.read_deliveries(spark, at["deliveries"]).collect()
    assert sorted((r.topic, r.flight, r.address) for r in sent) == [("a", 0, "h:1"), ("a", 1, "h:1"), ("b", 1, "h:2")]


def test_commits_follow_the_batch_and_snapshots_hold_all(spark, tmp_path):
    path = str(tmp_path)
    for batch_id in range(2 * SNAPSHOT + 2):
        before = next_numbers(spark, path, batch_id)
        written = spark.createDataFrame([(f"t{batch_id}", batch_id)], "topic string, next bigint")
        commit_batch(spark, path, batch_id, written, before)
    found = spark.read.parquet(f"{path}/commits").where("topic IS NOT NULL").groupBy("batch_id").count().collect()
    sizes = {r.batch_id: r["count"] for r in found}
    assert sizes == {i: i + 1 if i % SNAPSHOT == 0 else 1 for i in range(2 * SNAPSHOT + 2)}
    last = next_numbers(spark, path, 2 * SNAPSHOT + 2).collect()
    assert sorted((r.topic, r.next) for r in last) == sorted((f"t{i}", i) for i in range(2 * SNAPSHOT + 2))
    assert last_batch(spark, path) == 2 * SNAPSHOT + 1


def test_subscriber_state_is_folded_into_snapshots(spark, parts, monkeypatch):
    monkeypatch.setattr(batches, "SNAPSHOT", 2)
    for step in range(4):
        parts(step)
        source = parts.source().withColumn("k", b.number())
        topics.stream_subscribers(b.control_of(source), parts.table, parts.checkpoint)
    control = b.control_of(parts.events.withColumn("k", b.number()))
    state = topics.read_subscribers(spark, parts.table, b.TOPICS)
    assert _rows(state) == _rows(registry.subscribers_current(control, b.TOPICS))
    assert batches.read_batches(spark, parts.table, from_snapshot=True).agg(F.min("batch_id")).first()[0] == 2


def _files(folder):
    return [p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]


def _append(spark, path, batch_id, topics_of=("a", "b")):
    """One batch of a log: one event per topic, its offset the batch."""
    rows = [(batch_id, t, batch_id) for t in topics_of]
    batches.write_batch(spark.createDataFrame(rows, "event_id bigint, topic string, offset bigint").coalesce(1), path, batch_id, ["topic"])
    before = next_numbers(spark, path, batch_id)
    written = spark.createDataFrame([(t, batch_id + 1) for t in topics_of], "topic string, next bigint")
    commit_batch(spark, path, batch_id, written, before, ["topic"], ["offset"])


def test_an_old_log_is_read_from_few_files(spark, tmp_path, monkeypatch):
    """Batches are merged level by level; a read of the tail opens the folders of the tail; old folders go."""
    monkeypatch.setattr(batches, "SNAPSHOT", 3)
    monkeypatch.setattr(batches, "KEPT", 9)
    path = str(tmp_path / "log")
    log_schema = spark.createDataFrame([], "event_id bigint, topic string, offset bigint").schema
    batches.prepare(spark, path, log_schema)
    n = 31
    for batch_id in range(n):
        _append(spark, path, batch_id)
    parts = batches.live_parts(spark, path)
    assert [(p.first, p.last, p.level) for p in parts] == [(0, 26, 3), (27, 29, 1), (30, 30, 0)]
    log = topics.read_log(spark, path)
    assert sorted((r.topic, r.offset) for r in log.collect()) == [(t, i) for t in "ab" for i in range(n)]
    assert len(log.inputFiles()) <= 2 * len(parts)
    tail = topics.stream_read_from_offset(spark, path, "a", n - 2)
    assert sorted(r.offset for r in tail.collect()) == [n - 2, n - 1]
    assert len(tail.inputFiles()) <= 4 and all("-000000000000000026" not in f for f in tail.inputFiles())
    assert topics.stream_read_from_offset(spark, path, "none", 3).count() == 0
    assert len(list(Path(path, "commits").iterdir())) <= 9 and len(list(Path(path, "data").iterdir())) <= 2 * 3 + 1
    assert last_batch(spark, path) == n - 1
    Path(path, "last").unlink()
    assert last_batch(spark, path) == n - 1


def test_a_repeated_batch_repeats_its_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "SNAPSHOT", 3)
    path = str(tmp_path / "log")
    batches.prepare(spark, path, spark.createDataFrame([], "event_id bigint, topic string, offset bigint").schema)
    for batch_id in (0, 1, 2, 2, 3):
        _append(spark, path, batch_id)
    assert [(p.first, p.last) for p in batches.live_parts(spark, path)] == [(0, 2), (3, 3)]
    assert sorted(r.offset for r in topics.read_log(spark, path).where("topic = 'a'").collect()) == [0, 1, 2, 3]


def test_large_folders_are_not_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "SNAPSHOT", 3)
    monkeypatch.setattr(batches, "MERGE_BYTES", 1)
    path = str(tmp_path / "log")
    batches.prepare(spark, path, spark.createDataFrame([], "event_id bigint, topic string, offset bigint").schema)
    for batch_id in range(4):
        _append(spark, path, batch_id)
    assert [p.level for p in batches.live_parts(spark, path)] == [0, 0, 0, 0]
    assert topics.read_log(spark, path).count() == 8


def test_scratch_of_a_batch_goes_with_it(spark, parts, small_limits):
    """Four batches leave as little scratch as one, also when a batch is repeated."""
    from topicwell.session import fresh_path, shared_dir

    app = Path(shared_dir(spark), f"topicwell-{spark.sparkContext.applicationId}")
    Path(fresh_path(spark, "x")).parent.mkdir(parents=True, exist_ok=True)
    before = set(app.iterdir())
    intervals = registry.subscription_intervals(b.control(spark, SF), b.TOPICS)
    made = set()
    for step in range(4):
        parts(step)
        source = parts.source().where(F.col("topic").isin(b.TOPICS)).select(*EVENT)
        topics.stream_fan_out(source, lambda _: intervals, parts.table, parts.checkpoint)
        topics.stream_assign_offsets(source, parts.table + "2", parts.checkpoint + "2")
        made = {p for p in set(app.iterdir()) - before if p.name.startswith(("scope", "flights", "batch", "settled"))}
        if step == 0:
            first = made
    _repeat_last_batch(parts.checkpoint)
    topics.stream_fan_out(source, lambda _: intervals, parts.table, parts.checkpoint)
    assert made == first
    assert topics.read_log(spark, parts.table + "2").count() == parts.events.where(F.col("topic").isin(b.TOPICS)).count()


def test_scopes_end_also_when_work_fails(spark):
    from topicwell.session import fresh_path, scratch_scope, settle_table

    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark) as folder:
            settle_table(spark.range(3), "kept")
            assert list(Path(folder).iterdir())
            raise ZeroDivisionError
    assert not Path(folder).exists()
    assert "scope" not in fresh_path(spark, "x")


def test_viewers_are_pruned_while_deliveries_are_sent(spark, tmp_path):
    """Equal to the batch operator; a viewer that failed in the first batch gets nothing later."""
    rows = [(t, flight, f"h:{a}", 5) for flight in range(24) for t in "xy" for a in range(6)]
    schema = "topic string, flight bigint, address string, n bigint"
    df = spark.createDataFrame(rows, schema)
    failed = (F.col("address") == "h:1") & (F.col("flight") == 3) | (F.col("address") == "h:2") & F.col("flight").isin(13, 14)
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for part in range(4):
        df.where(F.col("flight").between(part * 6, part * 6 + 5)).coalesce(1).write.mode("append").parquet(folder)
        stream = intake.stream_parquet(spark, folder, df.schema, max_files=1)
        topics.stream_prune_failed(stream, failed, table, checkpoint)
        if part == 1:
            _repeat_last_batch(checkpoint)
    sent = topics.read_sent(spark, table)
    assert _rows(sent) == _rows(delivery.prune_failed(df, failed))
    assert sent.where("address = 'h:1'").agg(F.max("flight")).first()[0] == 3


TICK = "2025-03-27 09:00:00,ABC,{},100,1.00,1.10,0.10\n"


def test_files_are_taken_whole_while_they_arrive(spark, tmp_path):
    """One bad file among many, in folders that use a name twice; equal to the batch operator."""
    folder = tmp_path / "csv"
    for day in "ab":
        (folder / f"day={day}").mkdir(parents=True)
        for i in range(3):
            bad = day == "b" and i == 1
            lines = [TICK.format(1), TICK.format("cheap" if bad else 2), TICK.format("" if bad else 3)]
            (folder / f"day={day}" / f"{i}.csv").write_text("timestamp,stock,price,volume,bid,ask,spread\n" + "".join(lines))
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    run = lambda: intake.stream_accept_files(
        intake.stream_ticks_csv(spark, str(folder), max_files=2, typed=False), table, checkpoint
    )
    run()
    _repeat_last_batch(checkpoint)
    run()
    text = spark.read.schema(TICK_TEXT).option("header", True).csv(str(folder)).drop("day")
    judged = validation.with_reason(text.withColumn("file", F.input_file_name()))
    wanted = validation.file_atomic_accept(judged, F.col("reason").isNotNull(), row="timestamp")
    found = intake.read_accepted(spark, table)
    assert found.count() == 15 and found.schema["price"].dataType.simpleString() == "decimal(10,2)"
    assert {r.file.rsplit("csv/", 1)[1] for r in found.collect()} == {r.file.rsplit("csv/", 1)[1] for r in wanted.collect()}
    lost = intake.read_rejected(spark, table).collect()
    assert sorted(str(r.reason) for r in lost) == ["None", "price_invalid", "price_missing"]
    assert {r.file.rsplit("csv/", 1)[1] for r in lost} == {"day=b/1.csv"}


def test_answers_follow_the_times_not_the_arrival(spark, tmp_path):
    """Rows out of order inside the delay get the batch answers; rows behind the mark go to their own table."""
    rng = random.Random(4)
    log = []
    for i in range(400):
        kind = rng.choice(["subscribe", "unsubscribe", "add_topic", "remove_topic"])
        client = kind in ("subscribe", "unsubscribe")
        address = rng.choice(["h:1", "h:2", "bad"]) if client else None
        log.append((i, T0 + timedelta(seconds=rng.randrange(4000)), kind, rng.choice("xyz"), address))
    schema = "seq bigint, ts timestamp_ntz, action string, topic string, address string"
    arrival = sorted(log, key=lambda r: r[1] + timedelta(seconds=rng.randrange(300)))
    arrival.insert(350, (900, T0, "subscribe", "x", "h:1"))
    arrival.insert(360, (901, None, "subscribe", "x", "h:1"))
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for i in range(0, len(arrival), 60):
        spark.createDataFrame(arrival[i : i + 60], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = intake.stream_parquet(spark, folder, spark.createDataFrame([], schema).schema)
        topics.stream_control_responses(stream, ["x"], table, checkpoint, timedelta(seconds=300))
        if i == 120:
            _repeat_last_batch(checkpoint)
            topics.stream_control_responses(stream, ["x"], table, checkpoint, timedelta(seconds=300))
    mark = max(r[1] for r in log) - timedelta(seconds=300)
    whole = registry.control_responses(spark.createDataFrame(log, schema), ["x"])
    assert _rows(topics.read_answers(spark, table)) == _rows(whole.where(F.col("ts") < F.lit(mark)))
    assert sorted(r.seq for r in topics.read_late(spark, table).collect()) == [900, 901]
    # What a batch hands on is all that is held.
    assert [p.first for p in batches.live_parts(spark, f"{table}/held")] == [last_batch(spark, f"{table}/held")]
