"""The same rows whichever size branch runs: equal intervals, missing keys, ends and order values."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from compare import limits
from topicwell.functions.payload import columnar_payload
from topicwell.operators import validation
from topicwell.plans.joins import covered
from topicwell.plans.running import count_before, running
from topicwell.sources import tables

START = datetime(2025, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_covered(spark, how):
    points = [(k, at(5 * i), i) for k in ("a", "b", None) for i in range(12)]
    spans = [("a", 5, 35), ("a", 5, 35), ("a", 20, 40), (None, 0, 50), ("b", 30, None), ("b", None, 10), ("b", 9, 9)]
    points = spark.createDataFrame(points, "topic string, ts timestamp_ntz, n bigint")
    intervals = spark.createDataFrame(
        [(k, at(a), at(b)) for k, a, b in spans], "topic string, lo timestamp_ntz, hi timestamp_ntz"
    )

    def rows():
        return sorted(map(str, covered(points, intervals, "topic", "ts", "n", "lo", "hi", how).collect()))

    usual = rows()
    assert len(usual) == (6 + 4 + 6 if how == "inner" else 5 + 6 + 12)
    for group_rows, broadcast_rows in ((1000, 2), (3, 2)):
        with limits(spark, group_rows, broadcast_rows):
            assert rows() == usual


@pytest.mark.parametrize("shape", ["one value", "several values", "all null"])
def test_numbers_with_missing_times(spark, shape):
    time = {"one value": lambda i: 7, "several values": lambda i: i // 4, "all null": lambda i: None}[shape]
    rows = [("k", None if i % 2 else at(time(i)), i) for i in range(20)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp_ntz, event_id bigint")

    def numbers():
        out = running(df, ["topic"], ["ts", "event_id"], [count_before("n")]).collect()
        return sorted((r.event_id, r.n) for r in out)

    usual = numbers()
    assert sorted(n for _, n in usual) == list(range(20))
    for group_rows in (3, 7):
        with limits(spark, group_rows, 1000):
            assert numbers() == usual


def test_symbols_stay_text_and_ids_go_on(spark, tmp_path):
    row = "timestamp_ntz'2025-01-01 09:00:00' as timestamp", "1.50BD as price", "1 as volume"
    rest = "1.40BD as bid_price", "1.60BD as ask_price", "0.20BD as spread"
    ticks = spark.createDataFrame([("0700",), ("600519",)], "stock_symbol string").selectExpr("stock_symbol", *row, *rest)
    tables.append_ticks(ticks, str(tmp_path / "ticks"))
    read = tables.read_ticks(spark, str(tmp_path / "ticks"))
    assert sorted(r.stock_symbol for r in read.collect()) == ["0700", "600519"]
    numbered = validation.with_surrogate_id(read.withColumn("n", F.col("stock_symbol").cast("int")), ("timestamp", "n"), start=6)
    assert sorted(r.id for r in numbered.collect()) == [6, 7]


def test_reason_of_a_price_that_is_no_number(spark):
    text = spark.createDataFrame(
        [("2025-01-01 09:00:00", "A", "NaN", "1", "1", "1", "1")],
        "timestamp string, stock_symbol string, price string, volume string, bid_price string, ask_price string, spread string",
    )
    assert validation.split_valid_ticks(text)[1].first().reason == "price_not_a_number"


def test_payload_times(spark):
    df = spark.sql(
        "SELECT array(named_struct('ts', timestamp_ntz'2025-01-01 09:00:00.12'), named_struct('ts', timestamp_ntz'2025-01-01 09:00:01'),"
        " named_struct('ts', cast(null as timestamp_ntz))) AS rows"
    )
    text = df.select(columnar_payload(F.col("rows"), df.schema["rows"].dataType.elementType.fields)).first()[0]
    assert text == '{"ts":["2025-01-01 09:00:00.120000","2025-01-01 09:00:01",null]}'
