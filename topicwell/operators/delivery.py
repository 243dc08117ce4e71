"""Flights, fan-out to subscribers and delivery results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwell.functions.payload import columnar_payload
from topicwell.operators.offsets import assign_offsets
from topicwell.plans.joins import covered, keyed_join
from topicwell.schemas import EVENT_ORDER, EVENTS_PER_FLIGHT
from topicwell.session import settle, settle_table

DELIVERED, FAILED = "delivered", "failed"


def flight_batches(
    events: DataFrame, n: int = EVENTS_PER_FLIGHT, order: Sequence[str] = EVENT_ORDER
) -> DataFrame:
    """First-in-first-out chunks of at most ``n`` events per topic, drained at the last event."""
    return flights_of(assign_offsets(events, order), n, order)


def flights_of(log: DataFrame, n: int = EVENTS_PER_FLIGHT, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Flights of a log that already has offsets."""
    flight = F.call_function("div", F.col("offset"), F.lit(n)).cast("bigint")
    return (
        log.withColumn("flight", flight)
        .groupBy("topic", "flight")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(order[1], "offset").alias("first_event"),
            F.max_by(order[1], "offset").alias("last_event"),
            F.max(order[0]).alias("fts"),
        )
    )


def flight_rows(events: DataFrame, n: int = EVENTS_PER_FLIGHT) -> DataFrame:
    """The ticks of each flight as rows, from events ``(topic, number, rows)``.

    Events are numbered 0, 1, 2, ... per topic. Events without rows take a place in their flight
    and add nothing to it, as do absent ones.
    """
    flight = F.call_function("div", F.col("number"), F.lit(n)).cast("bigint")
    rows = events.select("topic", flight.alias("flight"), "number", F.explode("rows").alias("_row"))
    return rows.select("topic", "flight", "number", "_row.*")


def flight_events(log: DataFrame, n: int = EVENTS_PER_FLIGHT, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Flights with their at most ``n`` events as one ordered array ``rows``."""
    flight = F.call_function("div", F.col("offset"), F.lit(n)).cast("bigint")
    fields = [*order, *[c for c in log.columns if c not in (*order, "topic", "offset")]]
    return (
        log.withColumn("flight", flight)
        .groupBy("topic", "flight")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    )


def fan_out(flights: DataFrame, intervals: DataFrame) -> DataFrame:
    """One delivery per flight and address subscribed at the time the flight is drained."""
    return covered(flights, intervals, "topic", "fts", "flight", "valid_from", "valid_to").select(
        *flights.columns, "address"
    )


def undelivered_flights(flights: DataFrame, intervals: DataFrame) -> DataFrame:
    """Flights drained while nobody was subscribed."""
    return covered(flights, intervals, "topic", "fts", "flight", "valid_from", "valid_to", "left_anti")


def delivery_outcomes(deliveries: DataFrame, failed: Column) -> DataFrame:
    """Add ``status``. A failure touches its own delivery only; nothing is sent again."""
    return deliveries.withColumn("status", F.when(failed, FAILED).otherwise(DELIVERED))


def prune_failed(deliveries: DataFrame, failed: Column) -> DataFrame:
    """Deliveries of viewers that are dropped at their first failure: that one is the last.

    The deliveries are written once and read twice, for the first failures and for the rows.
    """
    deliveries = settle_table(deliveries.withColumn("_failed", failed), "deliveries")
    first = settle(deliveries.where("_failed").groupBy("topic", "address").agg(F.min("flight").alias("_first_failed")))
    known = keyed_join(deliveries, first, ["topic", "address"], "left", ["flight"])
    kept = F.col("_first_failed").isNull() | (F.col("flight") <= F.col("_first_failed"))
    return known.where(kept).drop("_first_failed", "_failed")


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("topic", "address").agg(
        F.count(F.lit(1)).alias("n_flights"), F.sum("n").alias("n_rows")
    )


def columnar_json(events: DataFrame) -> DataFrame:
    """Events whose array ``rows`` is replaced by a ``payload`` of one JSON array per column."""
    element = events.schema["rows"].dataType.elementType
    assert isinstance(element, T.StructType)
    payload = columnar_payload(F.col("rows"), element.fields)
    return events.select(*[c for c in events.columns if c != "rows"], payload.alias("payload"))
