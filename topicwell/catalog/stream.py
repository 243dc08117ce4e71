"""Registered streaming queries: the ``events`` table arrives in time order, in several micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicwell import bindings as b
from topicwell.catalog import batch
from topicwell.catalog.batch import EVENT, Query, write_tick_files
from topicwell.operators.registry import subscription_intervals
from topicwell.session import fresh_path, settle, settle_table
from topicwell.streaming import intake, topics


# How late a control row may come.
LATENESS = timedelta(hours=2)
# Parts of the table's time span that arrive one after the other.
ARRIVALS = 4


def _arrive(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """The whole table lands in time order, part by part; ``run`` takes each part as one micro-batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = fresh_path(spark, "arrivals")
    seen = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()

    def arrive(part: DataFrame) -> None:
        part.write.mode("append").parquet(folder)
        run(intake.stream_parquet(spark, folder, events.schema).withColumn("topic", F.col("event_type")))

    if seen.first is None:
        arrive(events)
        return
    width = (seen.last - seen.first) // ARRIVALS + timedelta(microseconds=1)
    for i in range(ARRIVALS):
        low, high = (F.lit(str(seen.first + width * j)).cast("timestamp_ntz") for j in (i, i + 1))
        part = (F.col("ts") >= low) & (F.col("ts") < high)
        if i == 0:
            part = part | F.col("ts").isNull()
        arrive(events.where(part))


def _registered(source: DataFrame) -> DataFrame:
    return source.where(F.col("topic").isin(b.TOPICS)).select(*EVENT)


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    path = fresh_path(spark, name)
    return f"{path}/table", f"{path}/checkpoint"


def stream_ticks_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = intake.stream_ticks_csv(spark, write_tick_files(spark, sf_dir)).drop("file")
    table, checkpoint = _paths(spark, "stream-ticks")
    intake.start_stream(ticks.writeStream.format("parquet").option("path", table), checkpoint)
    return spark.read.schema(ticks.schema).parquet(table)


def stream_accept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks in one file an hour, some with a value that breaks a rule; only whole good files are taken."""
    folder = fresh_path(spark, "tick-files")
    text = b.tick_text(spark, sf_dir).withColumn("hour", F.date_format(F.col("timestamp").cast("timestamp_ntz"), "yyyy-MM-dd-HH"))
    spoilt = F.when(F.col("event_id") % 1000 == 7, "none").otherwise(F.col("event_id").cast("string"))
    rows = text.select("timestamp", F.lit("A").alias("stock_symbol"), F.lit("1").alias("price"), spoilt.alias("volume"), *[F.lit("1").alias(c) for c in ("bid_price", "ask_price", "spread")], "hour")
    rows.repartition("hour").sortWithinPartitions("hour").write.option("header", True).partitionBy("hour").csv(folder)
    table, checkpoint = _paths(spark, "stream-accepted")
    intake.stream_accept_files(intake.stream_ticks_csv(spark, folder, typed=False), table, checkpoint)
    return intake.read_accepted(spark, table).select(F.col("volume").cast("bigint").alias("event_id"))


def stream_control_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control log arrives in four parts, every row up to two hours late; a last row moves the mark beyond all."""
    log = settle_table(b.control(spark, sf_dir), "control")
    folder = fresh_path(spark, "arrivals")
    table, checkpoint = _paths(spark, "stream-answers")
    # A row arrives up to two hours after its time, so rows of neighbouring parts come out of order.
    span = log.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    parts = []
    if span["first"] is not None:
        width = (span["last"] - span["first"] + LATENESS) // ARRIVALS + timedelta(microseconds=1)
        arrived = F.col("ts") + F.make_dt_interval(secs=F.pmod(F.xxhash64("seq"), F.lit(int(LATENESS.total_seconds()))))
        for i in range(ARRIVALS):
            low, high = (F.lit(str(span["first"] + width * j)).cast("timestamp_ntz") for j in (i, i + 1))
            parts.append(log.where((arrived >= low) & (arrived < high)))
        end = span["last"] + 2 * LATENESS
        parts.append(log.limit(1).select([F.lit(str(end)).cast("timestamp_ntz").alias(c) if c == "ts" else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]))
    for part in parts or [log]:
        part.write.mode("append").parquet(folder)
        stream = intake.stream_parquet(spark, folder, log.schema)
        topics.stream_control_responses(stream, b.TOPICS, table, checkpoint, LATENESS)
    return topics.read_answers(spark, table).select("seq", "action", "response")


def _routes(spark: SparkSession, sf_dir: str, route: str) -> DataFrame:
    table, checkpoint = _paths(spark, "stream-route")
    registered = b.topics(spark)
    _arrive(spark, sf_dir, lambda s: topics.stream_route(s.select(*EVENT), registered, table, checkpoint))
    return topics.read_routed(spark, table, route)


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir, topics.ROUTED)


def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir, topics.DEAD_LETTER)


def _log(spark: SparkSession, sf_dir: str) -> str:
    table, checkpoint = _paths(spark, "stream-log")
    _arrive(spark, sf_dir, lambda s: topics.stream_assign_offsets(_registered(s), table, checkpoint))
    return table


def stream_assign_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.read_log(spark, _log(spark, sf_dir))


def stream_read_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.stream_read_from_offset(spark, _log(spark, sf_dir), "view", 4)


def stream_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, checkpoint = _paths(spark, "stream-subscribers")

    def run(source: DataFrame) -> StreamingQuery:
        return topics.stream_subscribers(b.control_of(source.withColumn("k", b.number())), table, checkpoint)

    _arrive(spark, sf_dir, run)
    return topics.read_subscribers(spark, table, b.TOPICS)


def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, checkpoint = _paths(spark, "stream-deliveries")
    intervals = settle(subscription_intervals(b.control(spark, sf_dir), b.TOPICS))
    _arrive(spark, sf_dir, lambda s: topics.stream_fan_out(_registered(s), lambda _: intervals, table, checkpoint))
    return topics.read_deliveries(spark, table).select("topic", "flight", "address", "n")


def stream_prune_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries arrive in flight order, in several batches."""
    deliveries = settle_table(batch.deliveries(spark, sf_dir), "deliveries")
    folder = fresh_path(spark, "arrivals")
    table, checkpoint = _paths(spark, "stream-pruned")
    last = deliveries.agg(F.max("flight")).first()[0] or 0
    width = last // ARRIVALS + 1
    for i in range(ARRIVALS):
        part = F.col("flight").between(i * width, (i + 1) * width - 1)
        deliveries.where(part).write.mode("append").parquet(folder)
        stream = intake.stream_parquet(spark, folder, deliveries.schema)
        topics.stream_prune_failed(stream, batch.failed(), table, checkpoint)
    return topics.read_sent(spark, table)


def stream_topic_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, checkpoint = _paths(spark, "stream-tap")
    _arrive(spark, sf_dir, lambda s: topics.stream_topic_tap(s.select(*EVENT), "view", table, checkpoint))
    return spark.read.schema("event_id bigint, ts timestamp_ntz, topic string").parquet(table)


def stream_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event numbers held by the payloads of one topic."""
    return _payloads(spark, sf_dir, "view")


def stream_payloads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event numbers held by the payloads of all registered topics, from one stream."""
    return _payloads(spark, sf_dir, None)


def _payloads(spark: SparkSession, sf_dir: str, topic: str | None) -> DataFrame:
    table, checkpoint = _paths(spark, "stream-payloads")
    _arrive(spark, sf_dir, lambda s: topics.stream_payloads(_registered(s), topic, table, checkpoint))
    held = F.from_json("payload", "ts array<string>, event_id array<bigint>")
    sent = topics.read_payloads(spark, table).withColumn("held", held)
    return sent.select(
        "topic",
        "flight",
        F.array_join(F.col("held.event_id").cast("array<string>"), ",").alias("event_ids"),
        F.size("held.ts").cast("bigint").alias("n_ts"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        stream_ticks_csv,
        stream_accept_files,
        stream_control_responses,
        stream_route,
        stream_dead_letter,
        stream_assign_offsets,
        stream_read_from_offset,
        stream_subscribers,
        stream_fan_out,
        stream_prune_failed,
        stream_topic_tap,
        stream_payloads,
        stream_payloads_all,
    )
}
