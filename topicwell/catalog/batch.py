"""Registered batch queries over the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell import bindings as b
from topicwell.functions import control as bodies
from topicwell.functions.endpoints import valid_endpoint
from topicwell.operators import backlog, delivery, offsets, registry, replay, routing, validation
from topicwell.schemas import DATA_SECTION_BYTES, QUEUE_SLOTS
from topicwell.session import fresh_path, settle
from topicwell.sources import tables, ticks

Query = Callable[[SparkSession, str], DataFrame]
EVENT = ["event_id", "ts", "topic"]


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_registered(b.tagged(spark, sf_dir), b.topics(spark))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.assign_offsets(_routed(spark, sf_dir).select(*EVENT))


def write_log(spark: SparkSession, sf_dir: str) -> str:
    """The routed events as a written log, by topic and offset."""
    path = fresh_path(spark, "log")
    tables.partition_by_topic(_log(spark, sf_dir), path, order="offset")
    return path


_logs: dict[tuple, str] = {}


def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that readers read. A session writes it once for the files of a table as they stand."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (spark.sparkContext.applicationId, sf_dir, status.getLen(), status.getModificationTime())
    if key not in _logs:
        _logs[key] = write_log(spark, sf_dir)
    return spark.read.schema("event_id bigint, ts timestamp_ntz, offset bigint, topic string").parquet(_logs[key])


def _flights_of(events: DataFrame) -> DataFrame:
    routed = routing.route_registered(b.tagged_of(events), b.topics(events.sparkSession))
    return delivery.flight_batches(routed.select(*EVENT))


def _intervals_of(events: DataFrame) -> DataFrame:
    return registry.subscription_intervals(b.control_of(events), b.TOPICS)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.events(spark, sf_dir)
    return delivery.fan_out(_flights_of(events), _intervals_of(events)).select("topic", "flight", "address", "n")


def failed() -> Column:
    return F.col("flight") % 40 == 39


def write_tick_files(spark: SparkSession, sf_dir: str) -> str:
    """The ticks of the table as a new folder of CSV files."""
    path = fresh_path(spark, "ticks-csv")
    b.ticks(spark, sf_dir).withColumnRenamed("stock_symbol", "stock").write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)
    return path


def read_ticks_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.read_ticks_csv(spark, write_tick_files(spark, sf_dir)).drop("file")


def split_valid_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split_valid_ticks(b.tick_text(spark, sf_dir))[0]


def split_valid_ticks_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split_valid_ticks(b.tick_text(spark, sf_dir))[1].select("event_id", "reason")


def _day_files(spark: SparkSession, sf_dir: str, stop_at_first: bool) -> DataFrame:
    rows = b.events(spark, sf_dir).withColumn("file", F.date_format("ts", "yyyy-MM-dd-HH"))
    # The strict form stops at the first bad file, which should not be the very first one.
    bad = F.col("event_id") % 1000 == (507 if stop_at_first else 7)
    return validation.file_atomic_accept(rows, bad, stop_at_first=stop_at_first).select("event_id", "file")


def file_atomic_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_files(spark, sf_dir, False)


def file_atomic_accept_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_files(spark, sf_dir, True)


def with_surrogate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.with_surrogate_id(b.events(spark, sf_dir).select("event_id", "ts"), ("ts", "event_id"))


def append_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ticks")
    for _ in range(2):
        tables.append_ticks(b.ticks(spark, sf_dir), path)
    return tables.read_ticks(spark, path)


def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.scan_count(b.events(spark, sf_dir))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.events(spark, sf_dir).drop("k")
    earliest = events.where(F.col("event_type") == "click").agg(F.min("ts").cast("string")).first()[0]
    return routing.point_lookup(events, earliest, "click", "ts", "event_type")


def quote_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = b.ticks(spark, sf_dir).select("timestamp", "stock_symbol", "bid_price", "ask_price")
    return routing.quote_spread(quotes)


def tag_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.tag_topic(b.events(spark, sf_dir), F.col("event_type")).select(*EVENT)


def drop_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("k") % 10 != 0, F.col("event_type"))
    return routing.drop_untagged(routing.tag_topic(b.events(spark, sf_dir), topic)).select(*EVENT)


def route_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select(*EVENT)


def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.dead_letter(b.tagged(spark, sf_dir), b.topics(spark)).select(*EVENT)


def topic_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.topic_tap(b.tagged(spark, sf_dir), "view").select(*EVENT)


def partition_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "by-topic")
    tables.partition_by_topic(_routed(spark, sf_dir).select(*EVENT), path, order="ts")
    return spark.read.schema("event_id bigint, ts timestamp_ntz, topic string").parquet(path)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("k") % 10 == 9, "not json").otherwise(F.col("props"))
    return b.events(spark, sf_dir).select("event_id", body.alias("body"))


def skip_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skip_undecodable(_bodies(spark, sf_dir))[0]


def skip_undecodable_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skip_undecodable(_bodies(spark, sf_dir))[1]


def replay_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = b.tagged(spark, sf_dir)
    return replay.replay_slots(ticks, b.grid(ticks))


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = b.tagged(spark, sf_dir)
    return replay.replay_rows(ticks, b.grid(ticks)).select("slot", *EVENT)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = b.tagged(spark, sf_dir)
    return replay.replay_events(ticks, b.grid(ticks), ["event_id", "ts", "value"])


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.col("rows")
    return _replayed(spark, sf_dir).select(
        "slot",
        "topic",
        "part",
        "n_parts",
        F.size(rows).cast("bigint").alias("n_rows"),
        F.get(rows, F.lit(0))["event_id"].alias("first_event"),
        F.get(rows, F.size(rows) - 1)["event_id"].alias("last_event"),
    )


def parse_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.parse_control(b.control_bodies(spark, sf_dir)).select("seq", "address", "topic", "parse_status")


def valid_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = b.control(spark, sf_dir).where(F.col("address").isNotNull())
    return control.select("seq", "address", valid_endpoint(F.col("address")).alias("valid"))


def control_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the decoded client bodies, among the topic actions of the same log."""
    decoded = bodies.parse_control(b.control_bodies(spark, sf_dir)).drop("body")
    topic_actions = b.control(spark, sf_dir).where(F.col("address").isNull())
    control = decoded.unionByName(topic_actions.withColumn("parse_status", F.lit(bodies.OK)))
    return registry.control_responses(control, b.TOPICS).select("seq", "action", "response")


def topics_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.topics_current(b.control(spark, sf_dir), b.TOPICS)


def topic_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.topic_count(b.control(spark, sf_dir), b.TOPICS)


def has_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"))
    return registry.has_topic(b.control(spark, sf_dir), b.TOPICS, asked)


def subscription_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals_of(b.events(spark, sf_dir))


def subscription_intervals_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.subscription_intervals(b.control(spark, sf_dir), b.TOPICS, additive=True)


def subscribers_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.subscribers_current(b.control(spark, sf_dir), b.TOPICS)


def subscriber_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = b.control(spark, sf_dir)
    lists = registry.subscriber_lists(control, b.TOPICS, control.select("topic").distinct(), page_rows=3)
    return lists.withColumn("addresses", F.array_join("addresses", ","))


def connect_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.connect_sessions(b.sessions(spark, sf_dir))


def connect_sessions_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.connect_sessions(b.sessions(spark, sf_dir), additive=True)


def flight_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flights_of(b.events(spark, sf_dir))


def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of a topic are its events; every third slot belongs to it."""
    number = F.call_function("div", F.col("slot"), F.lit(len(b.TOPICS)))
    return delivery.flight_rows(_replayed(spark, sf_dir).withColumn("number", number)).drop("ts", "value")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir)


def undelivered_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.events(spark, sf_dir)
    lost = delivery.undelivered_flights(_flights_of(events), _intervals_of(events))
    return lost.select("topic", "flight", "n")


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_outcomes(deliveries(spark, sf_dir), failed())


def prune_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.prune_failed(deliveries(spark, sf_dir), failed())


def columnar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the payloads hold, read back from their text; some values are missing."""
    ticks = b.tagged(spark, sf_dir).withColumn("value", F.when(F.col("k") % 10 != 0, F.col("value")))
    events = replay.replay_events(ticks, b.grid(ticks), ["event_id", "ts", "value"])
    held = F.from_json("payload", "event_id array<bigint>, ts array<string>, value array<double>")
    parsed = delivery.columnar_json(events).withColumn("held", held)
    values = F.col("held.value").cast("array<decimal(18,6)>").cast("array<string>")
    return parsed.select(
        "slot",
        "topic",
        "part",
        "n_parts",
        F.array_join(F.col("held.event_id").cast("array<string>"), ",").alias("event_ids"),
        F.array_join("held.ts", ",").alias("times"),
        F.array_join(values, ",", "null").alias("vals"),
    )


def delivery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_stats(deliveries(spark, sf_dir))


def assign_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


def committed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.committed_offsets(written_log(spark, sf_dir), b.topics(spark))


def read_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.read_from_offset(written_log(spark, sf_dir), "view", 4)


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = written_log(spark, sf_dir)
    asked = b.requests(settle(offsets.committed_offsets(log)))
    return offsets.read_requests(log, asked).select("request_id", "topic", "offset", "event_id")


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = settle(offsets.committed_offsets(written_log(spark, sf_dir)))
    return offsets.resume_plan(b.requests(committed), committed)


def topic_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir).select("event_id", "ts", "topic", "props")
    return offsets.topic_volume(routed, F.length("props")).select("topic", "offset", "size", "start_byte")


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.queue_depth(b.queue_ops(spark, sf_dir), QUEUE_SLOTS).select("seq", "depth", "at_capacity")


def byte_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = backlog.byte_backlog(b.queue_ops(spark, sf_dir), F.col("size"), DATA_SECTION_BYTES)
    return waiting.select("seq", "bytes_used", "pct")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_ticks_csv,
        split_valid_ticks,
        split_valid_ticks_rejected,
        file_atomic_accept,
        file_atomic_accept_strict,
        with_surrogate_id,
        append_ticks,
        scan_count,
        point_lookup,
        quote_spread,
        tag_topic,
        drop_untagged,
        route_registered,
        dead_letter,
        topic_tap,
        partition_by_topic,
        skip_undecodable,
        skip_undecodable_skipped,
        replay_slots,
        replay_rows,
        replay_events,
        parse_control,
        control_responses,
        topics_current,
        topic_count,
        has_topic,
        subscription_intervals,
        subscription_intervals_additive,
        subscribers_current,
        subscriber_lists,
        connect_sessions,
        connect_sessions_additive,
        flight_batches,
        flight_rows,
        fan_out,
        undelivered_flights,
        delivery_outcomes,
        prune_failed,
        columnar_json,
        delivery_stats,
        assign_offsets,
        committed_offsets,
        read_from_offset,
        read_requests,
        resume_plan,
        topic_volume,
        queue_depth,
        byte_backlog,
    )
}
QUERIES["valid_endpoint"] = valid_endpoints
