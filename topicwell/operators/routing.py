"""Selection, tagging and routing of events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.joins import keyed_join
from topicwell.schemas import MONEY
from topicwell.session import settle


def point_lookup(
    ticks: DataFrame, ts: str | datetime, symbol: str, ts_col: str = "timestamp", symbol_col: str = "stock_symbol"
) -> DataFrame:
    """All columns of the ticks at one time for one symbol; both tests reach the file scan."""
    at = F.lit(str(ts)).cast(ticks.schema[ts_col].dataType)
    return ticks.where((F.col(ts_col) == at) & (F.col(symbol_col) == symbol))


def quote_spread(ticks: DataFrame, bid: str = "bid_price", ask: str = "ask_price") -> DataFrame:
    return ticks.withColumn("spread", F.round(F.col(ask) - F.col(bid), 2).cast(MONEY))


def tag_topic(events: DataFrame, topic: Column) -> DataFrame:
    return events.withColumn("topic", topic)


def drop_untagged(events: DataFrame) -> DataFrame:
    """Events with a topic; an empty text counts as none, as it names no folder of a table."""
    return events.where(F.col("topic") != "")


def route_registered(events: DataFrame, topics: DataFrame, row: str = "event_id") -> DataFrame:
    """Events whose topic is registered. ``row`` tells the events of one topic apart."""
    return keyed_join(events, settle(topics.select("topic")), ["topic"], "left_semi", [row])


def dead_letter(events: DataFrame, topics: DataFrame, row: str = "event_id") -> DataFrame:
    """Events whose topic is not registered, or that have none."""
    return keyed_join(events, settle(topics.select("topic")), ["topic"], "left_anti", [row])


def topic_tap(events: DataFrame, topic: str) -> DataFrame:
    return events.where(F.col("topic") == topic)


def skip_undecodable(events: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Events whose body is JSON, and those that are skipped because it is not."""
    decodable = F.try_parse_json(F.col(body)).isNotNull()
    return events.where(decodable), events.where(~decodable)
