"""Writers of tick and topic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicwell.schemas import TICK_FILE


def append_ticks(ticks: DataFrame, path: str) -> None:
    """Append ticks to a table by symbol, made if missing. A second run appends them again.

    The rebalance hint gives each symbol few files and splits large symbols over several tasks.
    """
    ticks.hint("rebalance", "stock_symbol").write.mode("append").partitionBy("stock_symbol").parquet(path)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``append_ticks`` writes. Symbols stay text: ``0700`` is not read as a number."""
    return spark.read.schema(TICK_FILE).parquet(path)


def partition_by_topic(events: DataFrame, path: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """Write one folder per topic. ``order`` sorts each file, so that its statistics narrow reads.

    Events without a topic, an empty one included, lie in the default folder and are read as null.
    """
    spread = events.hint("rebalance", "topic")
    if order:
        spread = spread.sortWithinPartitions("topic", order)
    spread.write.mode(mode).partitionBy("topic").parquet(path)
