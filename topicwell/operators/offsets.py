"""Per-topic offsets: numbering, committed positions and reads from an offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.joins import keyed_join
from topicwell.plans.running import count_before, running, total
from topicwell.schemas import EVENT_ORDER, READ_HORIZON, RECORD_OVERHEAD
from topicwell.session import settle, settle_table, settle_with

# Offsets of a read request that are made from one row.
BLOCK = 1024
# Values of ``status`` in a resume plan.
OK, CLAMPED, NO_DATA, ERROR, UNKNOWN_TOPIC = "ok", "clamped", "no_data", "error", "unknown_topic"


def assign_offsets(events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Add ``offset``: 0, 1, 2, ... per topic in append order."""
    return running(events, ["topic"], order, [count_before("offset")])


def topic_volume(
    events: DataFrame, size: Column, overhead: int = RECORD_OVERHEAD, order: Sequence[str] = EVENT_ORDER
) -> DataFrame:
    """Per event its ``offset``, ``size`` and the ``start_byte`` of its record in the topic's log."""
    sized = events.withColumn("size", size.cast("bigint"))
    record = F.col("size") + overhead
    scans = [count_before("offset"), total("start_byte", record, through=False)]
    return running(sized, ["topic"], order, scans)


def committed_offsets(log: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Next offset of each topic; registered ``topics`` without events stand at 0."""
    committed = log.groupBy("topic").agg((F.max("offset") + 1).alias("committed"))
    if topics is None:
        return committed
    empty = topics.select("topic", F.lit(0).cast("bigint").alias("committed"))
    return committed.unionByName(empty).groupBy("topic").agg(F.max("committed").alias("committed"))


def clamped_start(offset: int, committed: int, horizon: int = READ_HORIZON) -> int:
    """Where a read from ``offset`` starts: at most ``horizon`` events before the end."""
    return committed - horizon if committed - offset > horizon else offset


def read_from_offset(
    log: DataFrame, topic: str, offset: int, horizon: int = READ_HORIZON, committed: int | None = None
) -> DataFrame:
    """Events of a topic from ``offset`` up to the position committed now, at most ``horizon`` back.

    Both tests are literals, so they reach the file scan. An unknown topic, a start before 0 and
    an offset at or past the end give no rows; ``resume_plan`` tells them apart. Without ``committed`` the
    position is looked up in the log.
    """
    of_topic = log.where(F.col("topic") == topic)
    if committed is None:
        committed = of_topic.agg(F.max("offset") + 1).first()[0] or 0
    start = clamped_start(offset, committed, horizon)
    if start < 0:
        return of_topic.where(F.lit(False))
    return of_topic.where((F.col("offset") >= start) & (F.col("offset") < committed))


def resume_plan(requests: DataFrame, committed: DataFrame, horizon: int = READ_HORIZON) -> DataFrame:
    """Effective start, lag and status of read requests ``(topic, offset)``."""
    return _plan(requests, settle(committed), horizon).drop("committed")


def _plan(requests: DataFrame, committed: DataFrame, horizon: int) -> DataFrame:
    known = keyed_join(requests, committed, ["topic"], "left", requests.columns)
    lag = F.col("committed") - F.col("offset")
    start = F.when(lag > horizon, F.col("committed") - horizon).otherwise(F.col("offset"))
    status = (
        F.when(F.col("committed").isNull(), UNKNOWN_TOPIC)
        .when(start < 0, ERROR)
        .when(start >= F.col("committed"), NO_DATA)
        .when(lag > horizon, CLAMPED)
        .otherwise(OK)
    )
    return known.select(
        *[c for c in requests.columns if c != "offset"],
        F.col("offset").alias("requested"),
        F.when(F.col("committed").isNotNull(), start).alias("start"),
        lag.alias("lag"),
        F.when(F.col("committed").isNotNull(), start - F.col("offset")).alias("skipped"),
        status.alias("status"),
        "committed",
    )


def read_requests(log: DataFrame, requests: DataFrame, horizon: int = READ_HORIZON) -> DataFrame:
    """The events of many read requests ``(request_id, topic, offset)`` at once.

    No read reaches back more than ``horizon`` events, so the log is narrowed to the tail of each
    topic before the join. The first offset that any topic needs is a literal and reaches the scan
    of a written log. The offsets of a request are made block by block, whatever the horizon.
    """
    committed, seen = settle_with(committed_offsets(log), first=F.min("committed"))
    tail = keyed_join(log.where(F.col("offset") >= (seen["first"] or 0) - horizon), committed, ["topic"], "inner", ["offset"])
    tail = settle_table(tail.where(F.col("offset") >= F.col("committed") - horizon).drop("committed"), "tail")
    plan = _plan(requests, committed, horizon).where(F.col("status").isin(OK, CLAMPED))
    size = F.lit(BLOCK).cast("bigint")
    last = F.col("committed") - 1

    def block(value: Column) -> Column:
        return F.call_function("div", value, size)

    blocks = plan.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(last))))
    inside = F.sequence(F.greatest("start", F.col("_block") * size), F.least(last, F.col("_block") * size + size - 1))
    wanted = blocks.select("request_id", "topic", F.explode(inside).alias("offset"))
    return keyed_join(wanted, tail, ["topic", "offset"], "inner", ["request_id"])
