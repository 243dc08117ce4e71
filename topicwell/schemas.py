"""Schemas and fixed settings of the topic-stream data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
SYMBOL_LENGTH = 10

# Columns of a tick file, by position. The header names are not used.
TICK_FILE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("stock_symbol", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField("volume", T.IntegerType()),
        T.StructField("bid_price", MONEY),
        T.StructField("ask_price", MONEY),
        T.StructField("spread", MONEY),
    ]
)
TICK_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in TICK_FILE])

# Total order of events inside a topic.
EVENT_ORDER = ("ts", "event_id")
# Total order of control events.
CONTROL_ORDER = ("ts", "seq")

# Actions of the control log.
SUBSCRIBE = "subscribe"
UNSUBSCRIBE = "unsubscribe"
ADD_TOPIC = "add_topic"
REMOVE_TOPIC = "remove_topic"

# Settings of the service.
EVENTS_PER_FLIGHT = 5
READ_HORIZON = 100
RECORD_OVERHEAD = 4
QUEUE_SLOTS = 1000
DATA_SECTION_BYTES = 1024 * 1024 * 100

OPEN_END = "9999-01-01 00:00:00"
