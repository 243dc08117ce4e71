"""Bounds on rows that are known without a job."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import limits
from topicwell.plans import statistics
from topicwell.plans.running import cut
from topicwell.plans.statistics import most_rows, one_task
from topicwell.session import settle_table, table_size


@pytest.fixture
def table(spark):
    return settle_table(spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(5), "numbers")


def jobs(spark, work):
    group = f"counting {id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plans_that_make_no_rows(spark, table):
    few = spark.sql("SELECT * FROM VALUES (1L), (2L) AS t(k)")
    window = Window.partitionBy("k").orderBy("id")
    bounded = {
        1000: [table, table.where("k = 3").select("id"), table.groupBy("k").count(), table.withColumn("n", F.row_number().over(window))],
        2000: [table.unionByName(table), table.distinct().union(table)],
        1002: [table.join(F.broadcast(few), "k", "left_semi"), table.join(few, "k", "left_anti")],
        2: [few],
    }
    for rows, frames in bounded.items():
        for df in frames:
            assert jobs(spark, lambda: most_rows(df)) == (rows, 0)
            assert df.count() <= rows


def test_plans_that_may_make_rows(spark, table):
    assert most_rows(table.join(table.select("k"), "k")) is None
    assert most_rows(table.select(F.explode(F.array("id", "k")))) is None
    assert most_rows(table.crossJoin(table.select(F.col("id").alias("j")).limit(3))) is None


def test_many_or_large_files_are_left_to_a_count(spark, table, monkeypatch):
    assert one_task(table)
    monkeypatch.setattr(statistics, "FOOTERS", 4)
    assert most_rows(table) is None
    monkeypatch.setattr(statistics, "FOOTERS", 64)
    monkeypatch.setattr(statistics, "FOOTER_BYTES", 10)
    assert most_rows(table) is None


def test_a_table_that_grows_is_looked_at_again(spark, table):
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert most_rows(spark.read.parquet(path)) == 1000
    table.limit(50).coalesce(1).write.mode("append").parquet(path)
    assert most_rows(spark.read.parquet(path)) == 1050


def test_cutting_counts_only_what_may_be_too_large(spark, table):
    assert jobs(spark, lambda: cut(table, ["k"], ["id", "k"]).levels) == ([], 0)
    with limits(spark, 100, 10_000):
        cells, n = jobs(spark, lambda: cut(table, ["k"], ["id", "k"]))
        assert cells.levels and n > 0


def test_sizes_of_numbers_come_from_footers(spark, table):
    assert jobs(spark, lambda: table_size(table.where("k = 3"))) == ((1000, 16000), 0)
    texts = table.select(F.col("id").cast("string").alias("id"))
    size, n = jobs(spark, lambda: table_size(texts))
    assert size[0] == 1000 and n > 0
    with limits(spark, 100, 500):
        assert jobs(spark, lambda: table_size(table.where("k = 3")))[0][0] == 143
