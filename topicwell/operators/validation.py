"""Checks of tick rows and files, and row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.joins import keyed_join
from topicwell.plans.running import count_before, running
from topicwell.schemas import SYMBOL_LENGTH, TICK_FILE
from topicwell.session import settle


def with_reason(text: DataFrame) -> DataFrame:
    """Tick rows of text with the ``reason`` for which a row is rejected, or null.

    Every column must be present, symbols have at most 10 characters, prices fit
    ``decimal(10,2)`` after rounding, the volume is a 32-bit integer. The first value that cannot
    be taken gives the reason, then the first that is missing.
    """
    bad, missing = [], []
    for field in TICK_FILE:
        value, kind = F.col(field.name), field.dataType.simpleString()
        missing.append((value.isNull(), f"{field.name}_missing"))
        if field.name == "stock_symbol":
            bad.append((F.length(F.rtrim(value)) > SYMBOL_LENGTH, "stock_symbol_too_long"))
            continue
        lost = value.isNotNull() & value.try_cast(kind).isNull()
        if kind.startswith("decimal"):
            bad.append((lost & F.isnan(value.try_cast("double")), f"{field.name}_not_a_number"))
            bad.append((lost & value.try_cast("double").isNotNull(), f"{field.name}_overflow"))
        bad.append((lost, f"{field.name}_invalid"))

    reason = F.lit(None).cast("string")
    for condition, name in reversed(bad + missing):
        reason = F.when(condition, name).otherwise(reason)
    return text.withColumn("reason", reason)


def typed_ticks(text: DataFrame) -> DataFrame:
    """Valid tick rows of text with the types of ticks. Other columns pass through."""

    def typed(name: str, kind: str) -> Column:
        if name == "stock_symbol":
            return F.substring(name, 1, SYMBOL_LENGTH)
        return F.col(name).try_cast(kind)

    kinds = {f.name: f.dataType.simpleString() for f in TICK_FILE}
    return text.select([typed(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in text.columns])


def split_valid_ticks(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Divide tick rows of text into typed accepted rows and rejected rows with a ``reason``.

    Other columns pass through.
    """
    judged = with_reason(text)
    accepted = typed_ticks(judged.where(F.col("reason").isNull()).drop("reason"))
    return accepted, judged.where(F.col("reason").isNotNull())


def file_atomic_accept(
    rows: DataFrame, bad: Column, file: str = "file", row: str = "event_id", stop_at_first: bool = False
) -> DataFrame:
    """Keep only the rows of files without a bad row.

    ``stop_at_first`` also drops every file after the first bad one in name order. ``row`` tells
    the rows of one file apart.
    """
    if stop_at_first:
        first_bad = rows.where(bad).agg(F.min(file)).first()[0]
        return rows if first_bad is None else rows.where(F.col(file) < F.lit(first_bad))
    bad_files = settle(rows.where(bad).select(file).distinct())
    return keyed_join(rows, bad_files, [file], "left_anti", [row])


def with_surrogate_id(rows: DataFrame, order: tuple[str, str] | None = None, start: int = 1) -> DataFrame:
    """Add a unique ``id``: rising with gaps, or dense along ``order``.

    ``start`` is the first id: one more than the largest of an earlier load.
    """
    if order is None:
        return rows.select((F.monotonically_increasing_id() + start).alias("id"), "*")
    numbered = running(rows, [], order, [count_before("_before")])
    return numbered.select((F.col("_before") + start).alias("id"), *rows.columns)


def scan_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


def scan_fetch(rows: DataFrame) -> None:
    """Read every column of every row and keep nothing."""
    rows.write.format("noop").mode("overwrite").save()
