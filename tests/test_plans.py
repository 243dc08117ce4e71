"""What the plans promise: filters reach the files, whole topics do not reach one task."""

import re

import pytest
from pyspark.sql import functions as F

from compare import SF, limits
from topicwell.catalog.batch import QUERIES
from topicwell.operators import offsets, routing
from topicwell.session import broadcastable, build_session, settle, shared_dir
from tick_maker import FIRST_SECOND, generate_ticks
from topicwell.sources import tables, ticks


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_point_lookup_is_pushed_down(spark):
    text = plan(QUERIES["point_lookup"](spark, SF))
    assert re.search(r"PushedFilters: .*EqualTo\(ts,.*EqualTo\(event_type,click\)", text)
    assert "Exchange" not in text


def test_replay_rows_is_a_filter(spark):
    text = plan(QUERIES["replay_rows"](spark, SF))
    assert re.search(r"PushedFilters: .*In\(event_type.*GreaterThanOrEqual\(ts.*LessThan\(ts", text)
    assert "Join" not in text and "Exchange" not in text
    assert "struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


def test_read_of_a_written_log_is_pruned(spark, tmp_path):
    log = QUERIES["assign_offsets"](spark, SF)
    path = str(tmp_path / "log")
    tables.partition_by_topic(log, path, order="offset")
    stored = spark.read.schema("event_id bigint, ts timestamp_ntz, offset bigint, topic string").parquet(path)
    read = offsets.read_from_offset(stored, "view", 4)
    assert read.count() == 100
    text = plan(read)
    assert re.search(r"PartitionFilters: .*topic", text)
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(offset,88\)", text)
    assert "topic" in plan(routing.topic_tap(stored, "view")).split("PartitionFilters")[1]


@pytest.mark.parametrize("name", ["assign_offsets", "flight_batches", "topic_volume", "queue_depth"])
def test_large_topics_are_divided(spark, name):
    """Every window over the rows is partitioned by the cell as well."""
    with limits(spark, 50, 1000):
        text = plan(QUERIES[name](spark, SF))
    windows = re.findall(r"Arguments: \[.*windowspecdefinition\((.*?)(?:ASC|DESC)", text)
    assert windows and all("_cell" in w for w in windows)
    assert "SinglePartition" not in text


def test_fan_out_does_not_shuffle_flights_for_few_intervals(spark):
    text = plan(QUERIES["fan_out"](spark, SF))
    assert text.count("(unknown) Exchange") + len(re.findall(r"\d+\) Exchange", text)) <= 2
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize(
    "name", ["fan_out", "undelivered_flights", "prune_failed", "read_requests", "replay_events", "byte_backlog"]
)
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InPandas" not in text


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session().sparkContext is spark.sparkContext


def test_jdbc_options(spark, monkeypatch):
    """No database is reached here: only what is asked of Spark is looked at."""
    from pyspark.sql import DataFrameReader

    asked = {}
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, **more: asked.update(more, url=url, table=table))
    ticks.jdbc_ticks(spark, "jdbc:any", {"user": "u"}, 1, 1000, partitions=8)
    assert asked["column"] == "id" and asked["numPartitions"] == 8
    assert (asked["lowerBound"], asked["upperBound"], asked["properties"]) == (1, 1000, {"user": "u"})


def test_symbol_tables_prune(spark, tmp_path):
    path = str(tmp_path / "ticks")
    tables.append_ticks(generate_ticks(spark, ["ABC", "XYZ"], 100), path)
    found = routing.point_lookup(spark.read.parquet(path), FIRST_SECOND, "ABC")
    assert re.search(r"PartitionFilters: .*stock_symbol", plan(found))
    assert 1 <= found.count() <= 30
    assert found.agg(F.countDistinct("stock_symbol")).first()[0] == 1


def test_broadcast_check_counts_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("text"), F.array("id").alias("list"))
    assert broadcastable(df)
    with limits(spark, 1000, 99):
        assert not broadcastable(df)
    spark.conf.set("spark.topicwell.broadcastBytes", "50000")
    try:
        assert not broadcastable(df.select("*"))
        assert not broadcastable(settle(df))
    finally:
        spark.conf.unset("spark.topicwell.broadcastBytes")


def test_queries_read_the_written_log(spark):
    """No numbering of the whole log for a tail."""
    text = plan(QUERIES["read_from_offset"](spark, SF))
    assert re.search(r"PartitionFilters: .*topic", text) and "GreaterThanOrEqual(offset," in text
    for name in ("read_from_offset", "read_requests", "resume_plan", "committed_offsets"):
        assert "Window" not in plan(QUERIES[name](spark, SF))


# Jobs that run while the DataFrame is built; one of them finds the columns of the table.
JOBS = {
    "route_registered": 1,
    "assign_offsets": 1,
    "topic_volume": 1,
    "flight_batches": 1,
    "queue_depth": 1,
    "byte_backlog": 3,
    "subscription_intervals": 1,
    "fan_out": 6,
    "undelivered_flights": 6,
    "read_from_offset": 3,
    "read_requests": 12,
}


@pytest.mark.parametrize("name", JOBS)
def test_few_jobs_before_the_query_runs(spark, name):
    QUERIES["read_from_offset"](spark, SF)  # the log is written once
    group = f"building {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        QUERIES[name](spark, SF)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= JOBS[name]
