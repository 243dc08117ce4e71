"""Decoding of control bodies: a JSON object with an address and a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values of ``parse_status``.
OK = "ok"
UNDECODABLE = "undecodable"
ADDRESS_NOT_TEXT = "address_not_text"
TOPIC_NOT_TEXT = "topic_not_text"
TOPIC_NOT_A_KEY = "topic_not_a_key"


def _field(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    """Type name of a JSON value; null if the key is missing."""
    return F.schema_of_variant(value)


def parse_control(control: DataFrame, body: str = "body") -> DataFrame:
    """Add ``address``, ``topic`` and ``parse_status`` decoded from the JSON text in ``body``.

    Other keys are ignored. A body that is no JSON object, or lacks one of the two keys, is
    ``undecodable``. An address or topic that is not text is reported as such and left null.
    """
    value = F.try_parse_json(F.col(body))
    rows = control.withColumn("_value", value)
    address, topic = _kind(_field(F.col("_value"), "address")), _kind(_field(F.col("_value"), "topic"))
    is_object = F.schema_of_variant(F.col("_value")).startswith("OBJECT")
    status = (
        F.when(~F.coalesce(is_object, F.lit(False)) | address.isNull() | topic.isNull(), UNDECODABLE)
        .when(address != "STRING", ADDRESS_NOT_TEXT)
        .when(topic == "STRING", OK)
        .when(topic.startswith("OBJECT") | topic.startswith("ARRAY"), TOPIC_NOT_A_KEY)
        .otherwise(TOPIC_NOT_TEXT)
    )

    def text(name: str, kind: Column) -> Column:
        return F.when(is_object & (kind == "STRING"), F.try_variant_get(F.col("_value"), f"$.{name}", "string"))

    return rows.select(
        *control.columns,
        text("address", address).alias("address"),
        text("topic", topic).alias("topic"),
        status.alias("parse_status"),
    )
