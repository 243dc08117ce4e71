"""Joins with a large key and range joins, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from compare import limits
from pyspark.sql import functions as F

from topicwell.plans.joins import covered, keyed_join

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [(10_000, 10_000), (100, 5)], ids=["broadcast", "spread"])
def test_keyed_join(spark, how, limit):
    random.seed(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", i % 5) for i in range(2000)] + [(5000, None, 0)]
    left = spark.createDataFrame(rows, "id bigint, key string, low int")
    right = spark.createDataFrame(
        [("hot", i) for i in range(4)] + [(f"k{i}", 3) for i in range(0, 30, 2)], "key string, high int"
    )
    renamed = right.withColumnRenamed("key", "other")
    plain = left.join(renamed, (F.col("key") == F.col("other")) & (F.col("low") < F.col("high")), how).drop("other")
    with limits(spark, *limit):
        found = keyed_join(left, right, ["key"], how, ["id"], F.col("low") < F.col("high"))
        assert found.columns == plain.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def _minute(n):
    return T0 + timedelta(minutes=n)


def _case(kind):
    random.seed(kind)
    points, spans = [], []
    for topic, n in (("hot", 900), ("cold", 40), ("bare", 15)):
        at = 0
        for i in range(n):
            at += {"even": 1, "burst": random.choice([0, 0, 0, 50]), "sparse": 3}[kind]
            points.append((topic, i * 2 if kind == "sparse" else i, _minute(at)))
    for topic, n in (("hot", 150), ("cold", 10), ("other", 5)):
        for i in range(n):
            lo = random.randrange(-50, 1000)
            length = random.choice([0, 1, 2, 30, 700, -1])
            hi = datetime(9999, 1, 1) if length < 0 else _minute(lo + length)
            spans.append((topic, f"a{i}", _minute(lo), hi))
    # Intervals that start or end exactly at a point.
    spans += [("hot", "edge", points[5][2], points[9][2]), ("hot", "all", _minute(-99), datetime(9999, 1, 1))]
    return points, spans


@pytest.mark.parametrize("kind", ["even", "burst", "sparse"])
@pytest.mark.parametrize("limit", [(100_000, 10_000), (100, 10)], ids=["broadcast", "numbered"])
def test_covered(spark, kind, limit):
    points, spans = _case(kind)
    p = spark.createDataFrame(points, "topic string, flight bigint, fts timestamp_ntz")
    s = spark.createDataFrame(spans, "topic string, address string, lo timestamp_ntz, hi timestamp_ntz")
    pairs = sorted((t, n, a) for t, n, at in points for u, a, lo, hi in spans if t == u and lo <= at < hi)
    alone = sorted({(t, n) for t, n, _ in points} - {(t, n) for t, n, _ in pairs})
    with limits(spark, *limit):
        found = covered(p, s, "topic", "fts", "flight", "lo", "hi")
        assert sorted(tuple(r) for r in found.select("topic", "flight", "address").collect()) == pairs
        left = covered(p, s, "topic", "fts", "flight", "lo", "hi", "left_anti")
        assert sorted(tuple(r) for r in left.select("topic", "flight").collect()) == alone


def test_covered_without_intervals(spark):
    p = spark.createDataFrame([("t", 0, T0)], "topic string, flight bigint, fts timestamp_ntz")
    s = spark.createDataFrame([], "topic string, address string, lo timestamp_ntz, hi timestamp_ntz")
    assert covered(p, s, "topic", "fts", "flight", "lo", "hi").count() == 0
    assert covered(p, s, "topic", "fts", "flight", "lo", "hi", "left_anti").count() == 1
