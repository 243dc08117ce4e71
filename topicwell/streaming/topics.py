"""Streaming routing, offsets, subscriptions, fan-out and taps.

Every stream returns its query. Without a ``trigger`` it takes what has arrived and is done when the
call returns; with one it runs until it is stopped.

Topics and intervals are a ``Source``: a Parquet path, read anew for every batch, a function of the
session, called for every batch, or a DataFrame, which is fixed when the stream starts. A batch
that is run again takes the state of that time and replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from topicwell.operators.delivery import columnar_json, fan_out, flight_events, flights_of
from topicwell.operators.offsets import clamped_start, read_from_offset
from topicwell.operators.registry import control_responses, control_state, last_topic_actions, latest, subscribers_of_state
from topicwell.operators.routing import drop_untagged, topic_tap
from topicwell.plans.joins import keyed_join
from topicwell.plans.running import count_before, running
from topicwell.schemas import EVENT_ORDER, EVENTS_PER_FLIGHT, READ_HORIZON
from topicwell.session import settle, settle_table
from topicwell.streaming.batches import (
    commit_batch,
    last_batch,
    next_numbers,
    prepare,
    read_batches,
    read_numbers,
    read_range,
    snapshot_of,
    write_batch,
)
from topicwell.streaming.intake import Trigger, start_batches, start_stream

Source = DataFrame | str | Callable[[SparkSession], DataFrame]

ROUTED, DEAD_LETTER = "routed", "dead_letter"
# Folders over which deliveries are spread by the hash of their address.
ADDRESS_FOLDERS = 64


def _reader(source: Source) -> Callable[[SparkSession], DataFrame]:
    """How a batch gets the table as it stands."""
    if isinstance(source, str):
        return lambda spark: spark.read.parquet(source)
    if isinstance(source, DataFrame):
        fixed = settle(source)
        return lambda spark: fixed
    return source


def stream_route(
    events: DataFrame,
    topics: Source,
    path: str,
    checkpoint: str,
    row: str = "event_id",
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Write events to ``route=routed`` or ``route=dead_letter``, in one pass over each batch."""
    topics_now = _reader(topics)
    prepare(events.sparkSession, path, T.StructType([*events.schema, T.StructField("route", T.StringType())]))

    def route(batch: DataFrame, batch_id: int) -> None:
        known = settle(topics_now(batch.sparkSession).select("topic").distinct().withColumn("_known", F.lit(True)))
        marked = keyed_join(batch, known, ["topic"], "left", [row])
        kind = F.when(F.col("_known"), ROUTED).otherwise(DEAD_LETTER)
        write_batch(marked.withColumn("route", kind).drop("_known"), path, batch_id, ["route"])
        commit_batch(batch.sparkSession, path, batch_id, partition_by=["route"])

    return start_batches(events, route, checkpoint, trigger)


def read_routed(spark: SparkSession, path: str, route: str) -> DataFrame:
    return read_batches(spark, path).where(F.col("route") == route).drop("route", "batch_id")


def _numbered_on(numbers: DataFrame, before: DataFrame, name: str, spread: str) -> DataFrame:
    """Numbers of a batch go on from those of the batches before."""
    joined = keyed_join(numbers, before, ["topic"], "left", [spread])
    return joined.withColumn(name, F.coalesce("next", F.lit(0)) + F.col(name)).drop("next")


def stream_assign_offsets(
    events: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str] = EVENT_ORDER,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Append events to a log with dense offsets per topic; events without a topic are skipped.

    Batches are appended as they arrive; ``order`` holds inside a batch. A batch that is run again
    takes the same offsets and replaces its own folder. The source is read once per batch.
    """
    prepare(events.sparkSession, path, T.StructType([*events.schema, T.StructField("offset", T.LongType())]))

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = settle(next_numbers(spark, path, batch_id))
        batch = settle_table(drop_untagged(batch), "batch")
        numbered = running(batch, ["topic"], order, [count_before("offset")])
        write_batch(_numbered_on(numbered, before, "offset", order[1]), path, batch_id, ["topic"])
        counts = batch.groupBy("topic").agg(F.count(F.lit(1)).alias("next_own"))
        written = settle(_numbered_on(counts, before, "next_own", "topic").withColumnRenamed("next_own", "next"))
        commit_batch(spark, path, batch_id, written, before, ["topic"], ["offset"])

    return start_batches(events, append, checkpoint, trigger)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path).drop("batch_id")


def stream_read_from_offset(
    spark: SparkSession, path: str, topic: str, offset: int, horizon: int = READ_HORIZON
) -> DataFrame:
    """A clamped read of the log a stream has appended so far; it ends at the committed position.

    The position comes from the last commits and the folders from their index, so how many files are opened
    depends on the events that are read, not on the age of the log.
    """
    last = last_batch(spark, path)
    known = None if last is None else next_numbers(spark, path, last + 1).where(F.col("topic") == topic).first()
    committed = known["next"] if known else 0
    log = read_numbers(spark, path, topic, clamped_start(offset, committed, horizon)).drop("batch_id")
    return read_from_offset(log, topic, offset, horizon, committed)


def stream_subscribers(
    control: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Keep the last action per topic and per address as streaming state; write what changed.

    Every so many batches the changes since the last snapshot are folded into a new one, so that a
    read folds the state and few batches, not the history.
    """
    state = control_state(control)
    prepare(control.sparkSession, path, state.schema)

    def changed(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id == snapshot_of(batch_id):
            earlier = read_range(spark, path, snapshot_of(batch_id - 1), batch_id - 1).drop("batch_id")
            batch = latest(earlier.unionByName(batch))
        write_batch(batch, path, batch_id)
        commit_batch(spark, path, batch_id, forget=snapshot_of(batch_id))

    return start_batches(state, changed, checkpoint, trigger, "update")


def read_subscribers(spark: SparkSession, path: str, initial: Sequence[str]) -> DataFrame:
    state = latest(read_batches(spark, path, from_snapshot=True))
    return subscribers_of_state(state, initial)


def stream_control_responses(
    control: DataFrame,
    initial: Sequence[str],
    path: str,
    checkpoint: str,
    delay: timedelta,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Answer client actions in the order of their times, though they arrive in another.

    An answer depends on the topics registered at its time, so a row waits until the newest time seen is
    ``delay`` ahead of it. Then all rows before that mark are answered in order, after the last topic action of each
    topic that was answered before. Rows that come behind the mark, or without a time, go to a table of their
    own, unanswered. Each batch hands on what waits, the last topic actions and its mark, and no more.
    """
    answers, late, held = (f"{path}/{x}" for x in ("answers", "late", "held"))
    kinds = {f.name: f.dataType for f in control.schema}
    told = [*[(c, kinds[c]) for c in ("seq", "ts", "action", "topic", "address")], ("response", T.StringType())]
    prepare(control.sparkSession, answers, T.StructType([T.StructField(c, kind) for c, kind in told]))
    prepare(control.sparkSession, late, T.StructType([*control.schema]))
    prepare(control.sparkSession, held, T.StructType([*control.schema, T.StructField("waits", T.BooleanType())]))
    columns = control.columns
    at = ((F.col("ts") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = settle(next_numbers(spark, held, batch_id))
        mark = (before.first() or {"next": -(2**62)})["next"]
        batch = settle_table(batch, "batch")
        newest = batch.agg(F.max(at)).first()[0]
        ahead = mark if newest is None else max(mark, newest - delay // timedelta(microseconds=1))
        earlier = read_range(spark, held, batch_id - 1, batch_id - 1) if batch_id else None
        waiting = batch.where(at >= mark)
        state = batch.where(F.lit(False))
        if earlier is not None:
            waiting = waiting.unionByName(earlier.where("waits").select(*columns))
            state = earlier.where(~F.col("waits")).select(*columns)
        due = settle_table(state.unionByName(waiting.where(at < ahead)), "due")
        write_batch(control_responses(due, initial), answers, batch_id)
        write_batch(batch.where(at.isNull() | (at < mark)), late, batch_id)
        rest = waiting.where(at >= ahead).withColumn("waits", F.lit(True))
        write_batch(rest.unionByName(last_topic_actions(due).select(*columns).withColumn("waits", F.lit(False))), held, batch_id)
        commit_batch(spark, answers, batch_id, order=["ts", "seq"])
        commit_batch(spark, late, batch_id, order=["ts", "seq"])
        reached = spark.sql("SELECT '' AS topic, CAST(:mark AS BIGINT) AS next", args={"mark": ahead})
        commit_batch(spark, held, batch_id, reached, before, forget=batch_id)

    return start_batches(control, answer, checkpoint, trigger)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers given so far by ``stream_control_responses``."""
    return read_batches(spark, f"{path}/answers").drop("batch_id")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came too late for an answer."""
    return read_batches(spark, f"{path}/late").drop("batch_id")


def stream_fan_out(
    events: DataFrame,
    intervals: Source,
    path: str,
    checkpoint: str,
    n: int = EVENTS_PER_FLIGHT,
    order: Sequence[str] = EVENT_ORDER,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Cut each micro-batch into flights and write their deliveries.

    A micro-batch is one drain, so its last flight of a topic may be partial; the flights of the
    next batch are numbered on from it. ``intervals`` are the subscriptions, looked up per batch.
    """
    intervals_now = _reader(intervals)
    kinds = {f.name: f.dataType for f in events.schema}
    fields = {
        "topic": kinds["topic"],
        "flight": T.LongType(),
        "n": T.LongType(),
        "first_event": kinds[order[1]],
        "last_event": kinds[order[1]],
        "fts": kinds[order[0]],
        "address": T.StringType(),
        "folder": T.LongType(),
    }
    prepare(events.sparkSession, path, T.StructType([T.StructField(c, kind) for c, kind in fields.items()]))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = settle(next_numbers(spark, path, batch_id))
        numbered = running(drop_untagged(batch), ["topic"], order, [count_before("offset")])
        flights = settle_table(_numbered_on(flights_of(numbered, n, order), before, "flight", "flight"), "flights")
        folder = F.pmod(F.xxhash64("address"), F.lit(ADDRESS_FOLDERS))
        deliveries = fan_out(flights, intervals_now(spark)).withColumn("folder", folder)
        write_batch(deliveries.hint("rebalance", "folder"), path, batch_id, ["folder"])
        written = settle(flights.groupBy("topic").agg((F.max("flight") + 1).alias("next")))
        commit_batch(spark, path, batch_id, written, before, ["folder"], ["topic", "flight"])

    return start_batches(events, deliver, checkpoint, trigger)


def read_deliveries(spark: SparkSession, path: str, address: str | None = None) -> DataFrame:
    """Deliveries written by ``stream_fan_out``; those of one address come from one folder."""
    found = read_batches(spark, path)
    if address is not None:
        found = found.where(
            (F.col("folder") == F.pmod(F.xxhash64(F.lit(address)), F.lit(ADDRESS_FOLDERS)))
            & (F.col("address") == address)
        )
    return found.drop("folder", "batch_id")


def stream_prune_failed(
    deliveries: DataFrame, failed: Column, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Deliveries as they are sent, none to a viewer after its first failure.

    ``deliveries`` come in flight order, batch by batch. The first failed flight of a (topic, address) is
    final: it is kept in a table beside the deliveries, of which every so many batches all that is known is
    folded into one batch. A viewer that failed in an earlier batch gets nothing any more.
    """
    table, failures = f"{path}/sent", f"{path}/failed"
    kinds = {f.name: f.dataType for f in deliveries.schema}
    prepare(deliveries.sparkSession, table, T.StructType([*deliveries.schema]))
    first_failed = [("topic", kinds["topic"]), ("address", kinds["address"]), ("first_failed", kinds["flight"])]
    prepare(deliveries.sparkSession, failures, T.StructType([T.StructField(c, kind) for c, kind in first_failed]))
    viewer = ["topic", "address"]

    def send(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = settle_table(batch.withColumn("_failed", failed), "deliveries")
        earlier = _failures(spark, failures, batch_id - 1) if batch_id else None
        new = batch.where("_failed").groupBy(*viewer).agg(F.min("flight").alias("first_failed"))
        known = new if earlier is None else earlier.unionByName(new).groupBy(*viewer).agg(F.min("first_failed").alias("first_failed"))
        known = settle_table(known, "failed")
        out = keyed_join(batch, known, viewer, "left", ["flight"])
        sent = out.where(F.col("first_failed").isNull() | (F.col("flight") <= F.col("first_failed")))
        write_batch(sent.drop("_failed", "first_failed"), table, batch_id)
        commit_batch(spark, table, batch_id, order=["topic", "flight"])
        write_batch(known if batch_id == snapshot_of(batch_id) else new, failures, batch_id)
        commit_batch(spark, failures, batch_id, forget=snapshot_of(batch_id))

    return start_batches(deliveries, send, checkpoint, trigger)


def _failures(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The first failed flight of each viewer up to a batch."""
    held = read_range(spark, path, snapshot_of(batch_id), batch_id)
    return held.groupBy("topic", "address").agg(F.min("first_failed").alias("first_failed"))


def read_sent(spark: SparkSession, path: str) -> DataFrame:
    """Deliveries written by ``stream_prune_failed``."""
    return read_batches(spark, f"{path}/sent").drop("batch_id")


def stream_topic_tap(
    events: DataFrame, topic: str, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Append the events of one topic to a Parquet folder as they arrive."""
    writer = topic_tap(events, topic).writeStream.format("parquet").option("path", path)
    return start_stream(writer, checkpoint, trigger)


def stream_payloads(
    events: DataFrame,
    topic: str | None,
    path: str,
    checkpoint: str,
    n: int = EVENTS_PER_FLIGHT,
    order: Sequence[str] = EVENT_ORDER,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """What viewers of one topic, or of every topic if it is None, are sent: the columnar JSON of each flight."""
    fields = [T.StructField("topic", events.schema["topic"].dataType), T.StructField("flight", T.LongType())]
    prepare(events.sparkSession, path, T.StructType([*fields, T.StructField("payload", T.StringType())]))

    def send(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = settle(next_numbers(spark, path, batch_id))
        wanted = drop_untagged(batch) if topic is None else topic_tap(batch, topic)
        numbered = running(wanted, ["topic"], order, [count_before("offset")])
        flights = _numbered_on(flight_events(numbered, n, order), before, "flight", "flight")
        flights = settle_table(columnar_json(flights), "payloads")
        write_batch(flights, path, batch_id)
        written = settle(flights.groupBy("topic").agg((F.max("flight") + 1).alias("next")))
        commit_batch(spark, path, batch_id, written, before, order=["topic", "flight"])

    return start_batches(events, send, checkpoint, trigger)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path).drop("batch_id")
