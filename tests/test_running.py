"""Running values over divided keys against plain windows."""

import random
from datetime import datetime, timedelta

import pytest
from compare import limits
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicwell.plans.running import count_before, cut, following, lifted, lowest, previous, running, total

T0 = datetime(2024, 1, 1)


def _rows(kind, n=1500):
    """(key, ts, id, value) rows with one key that holds most of them."""
    random.seed(kind)
    rows = []
    for i in range(n):
        key = "hot" if random.random() < 0.8 else random.choice(["a", "b", None])
        at = {
            "even": i,
            "one_time": 7,
            "burst": random.choice([3, 3, 3, 3, i]),
            "far": random.choice([i, 10**9 + i % 5]),
            "few_times": i % 3,
            "some_null": None if i % 4 == 0 else i,
        }[kind]
        ts = None if at is None else T0 + timedelta(seconds=at)
        number = (i * 7919) % n - n // 2 if kind != "one_time" else 2**60 + i
        rows.append((key, ts, number, random.choice([None, None, i])))
    return rows


KINDS = ["even", "one_time", "burst", "far", "few_times", "some_null"]
CASES = [(kind, ["key"], 10_000) for kind in KINDS] + [("burst", [], 10_000), ("some_null", [], 30), ("far", ["key"], 30)]
ORDER = ["ts", "id"]


def _scans():
    value = F.col("value")
    return [
        count_before("n"),
        total("through", F.coalesce(value, F.lit(1))),
        total("before", value, through=False),
        lowest("low", value),
        lowest("low_before", value, through=False),
        previous("prev", value, ORDER),
        following("next", value, ORDER),
    ]


def _plain(df, keys):
    forward = Window.partitionBy(*keys).orderBy("ts", "id")
    upto = forward.rowsBetween(Window.unboundedPreceding, 0)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    after = forward.rowsBetween(1, Window.unboundedFollowing)
    value = F.col("value")
    return df.select(
        "*",
        (F.row_number().over(forward) - 1).alias("n"),
        F.sum(F.coalesce(value, F.lit(1))).over(upto).alias("through"),
        F.coalesce(F.sum(value).over(before), F.lit(0)).alias("before"),
        F.min(value).over(upto).alias("low"),
        F.min(value).over(before).alias("low_before"),
        F.last(value, ignorenulls=True).over(before).alias("prev"),
        F.first(value, ignorenulls=True).over(after).alias("next"),
    )


def _sorted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("kind,keys,broadcast", CASES)
def test_same_as_plain_window(spark, kind, keys, broadcast):
    df = spark.createDataFrame(_rows(kind), "key string, ts timestamp_ntz, id bigint, value bigint").repartition(4)
    with limits(spark, 100, broadcast):
        assert _sorted(running(df, keys, ORDER, _scans())) == _sorted(_plain(df, keys))


@pytest.mark.parametrize("kind", KINDS)
def test_no_cell_is_larger_than_the_limit(spark, kind):
    df = spark.createDataFrame(_rows(kind), "key string, ts timestamp_ntz, id bigint, value bigint")
    with limits(spark, 100, 10_000):
        cells = cut(df, ["key"], ORDER)
        sizes = cells.assign(df).groupBy("key", *cells.columns).count()
        assert cells.levels
        assert sizes.agg(F.max("count")).first()[0] <= 100


def test_cell_count_stays_within_the_broadcast_limit(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("ts"), "id")
    with limits(spark, 10, 200):
        cells = cut(df, ["key"], ["ts", "id"])
        assert 20 < cells.assign(df).select(*cells.columns).distinct().count() <= 200


def test_small_keys_are_not_divided(spark):
    df = spark.createDataFrame(_rows("even", 300), "key string, ts timestamp_ntz, id bigint, value bigint")
    assert cut(df, ["key"], ORDER).levels == []


@pytest.mark.parametrize("kind", ["timestamp", "int", "bigint"])
def test_order_types(spark, kind):
    df = spark.range(3000).withColumn("key", F.lit("k"))
    df = df.withColumn("ts", F.timestamp_seconds("id") if kind == "timestamp" else F.col("id").cast(kind))
    with limits(spark, 100, 10_000):
        found = running(df, ["key"], ORDER, [count_before("n")])
        assert found.where("n <> id").count() == 0


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("keys", [["key"], []])
def test_lifted_sums(spark, kind, keys):
    """Against a step-by-step queue, in one call with another scan, over cells and over whole keys."""
    rows = _rows(kind)
    schema = "key string, ts timestamp_ntz, id bigint, value bigint"
    df = spark.createDataFrame(rows, schema).repartition(4).withColumn("change", F.when(F.col("value").isNull(), -1).otherwise(1))
    wanted, depths = {}, {}
    for key, ts, number, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        own = key if keys else None
        level = depths.get(own, 0) + (1 if value is not None else -1)
        wanted[number] = level
        depths[own] = max(level, 0)
    for limit in (100, 10_000):
        with limits(spark, limit, 10_000):
            found = running(df, keys, ORDER, [lifted("level", F.col("change")), count_before("n")])
            assert {r.id: r.level for r in found.collect()} == wanted


def test_one_pass_over_the_queue(spark):
    df = spark.createDataFrame(_rows("even"), "key string, ts timestamp_ntz, id bigint, value bigint")
    change = F.when(F.col("value").isNull(), -1).otherwise(1)
    plan = running(df, ["key"], ORDER, [lifted("level", change), total("sum", change)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort ") == 1
