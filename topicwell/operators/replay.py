"""Replay of stored ticks on a grid of time slots that visits the topics in turn."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.joins import keyed_join
from topicwell.plans.running import count_before, running
from topicwell.schemas import EVENT_ORDER
from topicwell.session import settle

# Ticks in one array of a replayed event; a larger event has several parts.
PART_ROWS = 10_000


class Grid:
    """Slot ``i`` shows topic ``i mod N`` at ``start + i * step`` seconds.

    With ``per_topic`` every topic sees every step: slot ``i`` is at ``start + (i div N) * step``.
    """

    def __init__(
        self, topics: Sequence[str], start: datetime, step: int, n_slots: int, per_topic: bool = False
    ) -> None:
        self.topics = list(topics)
        self.start = start
        self.step = step
        self.n_slots = n_slots
        self.per_topic = per_topic
        self.turns = -(-n_slots // len(self.topics)) if per_topic else n_slots

    @classmethod
    def covering(cls, topics: Sequence[str], events: DataFrame, step: int, ts: str = "ts") -> Grid:
        """The grid of whole steps from the first to the last event; events without a time are on no grid.

        The times are without zone. A table without any time has a grid without slots.
        """
        seen = events.agg(F.min(ts).alias("first"), F.max(ts).alias("last")).first()
        epoch, turn = datetime(1970, 1, 1), timedelta(seconds=step)
        if seen["first"] is None:
            return cls(topics, epoch, step, 0)
        first, last = ((seen[c] - epoch) // turn for c in ("first", "last"))
        return cls(topics, epoch + first * turn, step, last - first + 1)

    def _time(self, at: datetime) -> Column:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")

    def _turn(self, index: Column) -> Column:
        return F.call_function("div", index, F.lit(len(self.topics))) if self.per_topic else index

    def describe(self) -> list[Column]:
        """``slot``, ``t`` and ``topic`` from the slot number."""
        names = F.array(*[F.lit(t) for t in self.topics])
        slot = F.col("slot")
        time = self._time(self.start) + F.make_dt_interval(secs=self._turn(slot) * self.step)
        topic = F.element_at(names, (slot % len(self.topics) + 1).cast("int"))
        return [slot, time.alias("t"), topic.alias("topic")]

    def slots(self, like: DataFrame) -> DataFrame:
        """All slots ``(slot, t, topic)``."""
        return like.sparkSession.range(self.n_slots).withColumnRenamed("id", "slot").select(self.describe())

    def place(self, events: DataFrame, ts: str) -> DataFrame:
        """The events of the grid with their ``slot``. A filter only: nothing is joined."""
        end = self.start + timedelta(seconds=self.step * self.turns)
        seen = events.where(
            F.col("topic").isin(self.topics) & (F.col(ts) >= self._time(self.start)) & (F.col(ts) < self._time(end))
        )
        seconds = (F.col(ts) - self._time(self.start)).cast("interval second").cast("bigint")
        turn = F.call_function("div", seconds, F.lit(self.step))
        place = F.array_position(F.array(*[F.lit(t) for t in self.topics]), F.col("topic")) - 1
        if self.per_topic:
            slotted = seen.withColumn("slot", turn * len(self.topics) + place)
            return slotted.where(F.col("slot") < self.n_slots)
        return seen.withColumn("slot", turn).where(F.pmod(F.col("slot"), F.lit(len(self.topics))) == place)


def replay_rows(events: DataFrame, grid: Grid, ts: str = "ts") -> DataFrame:
    """The ticks of all slots, each with its ``slot``."""
    return grid.place(events, ts)


def replay_slots(events: DataFrame, grid: Grid, ts: str = "ts") -> DataFrame:
    """Every slot with the number of its ticks, 0 included."""
    counts = grid.place(events, ts).groupBy("slot").agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.slots(events).join(counts, "slot", "left").select(
        "slot", "t", "topic", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def replay_events(
    events: DataFrame,
    grid: Grid,
    columns: Sequence[str] | None = None,
    order: Sequence[str] = EVENT_ORDER,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The event of every slot with its ticks as one ordered array ``rows``, empty if it has none.

    An event of more than ``part_rows`` ticks comes as parts 0, 1, 2, ... so that no single row
    grows with the data; ``n_parts`` tells how many there are. An empty event has one part.
    """
    columns = list(columns or events.columns)
    placed = grid.place(events, order[0])
    numbered = running(placed, ["slot"], order, [count_before("_before")])
    fields = [*order, *[c for c in columns if c not in order]]
    parts = (
        numbered.withColumn("part", F.call_function("div", F.col("_before"), F.lit(part_rows)))
        .groupBy("slot", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
        .select(*grid.describe(), "part", "rows")
    )
    # One row per slot of the grid.
    sizes = settle(placed.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("bigint").alias("n_parts")))
    parts = keyed_join(parts, sizes, ["slot"], "inner", ["part"])
    # Empty events are added rather than joined, so the parts of a large one do not meet in one task.
    empty = grid.slots(events).join(sizes, "slot", "left_anti").select(
        "*",
        F.lit(0).cast("bigint").alias("part"),
        F.array().cast(parts.schema["rows"].dataType).alias("rows"),
        F.lit(1).cast("bigint").alias("n_parts"),
    )
    return parts.unionByName(empty)
