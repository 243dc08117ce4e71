"""Columnar JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON has these types itself; every other value is sent as text.
_JSON_TYPES = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.StringType,
)


def _time_text(value: Column) -> Column:
    """Seconds, and six digits of a fraction that is not zero."""
    text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(F.endswith(text, F.lit(".000000")), F.substring(text, 1, 19)).otherwise(text)


def columnar_payload(rows: Column, fields: Sequence[T.StructField]) -> Column:
    """JSON object with one array per field from an array of row structs; nulls are kept."""

    def values(field: T.StructField) -> Column:
        column = rows.getField(field.name)
        if isinstance(field.dataType, _JSON_TYPES):
            return column
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.transform(column, _time_text)
        return F.transform(column, lambda v: v.cast("string"))

    columns = F.struct(*[values(f).alias(f.name) for f in fields])
    return F.to_json(columns, {"ignoreNullFields": "false"})
