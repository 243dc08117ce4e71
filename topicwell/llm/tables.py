"""Shared table steps: settled Parquet tables, size-checked joins, numbering and components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwell.session import fresh_path

# Rows of a key table that may be broadcast, and bytes. Larger ones are joined by a shuffle.
KEY_ROWS = 1_500_000
KEY_BYTES = 48 * 1024 * 1024


# Rows of one Arrow batch. Texts are long, and a batch is held twice outside the JVM's heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Shorten the session's Arrow batches, unless the cluster or the caller has set their length."""
    if spark.conf.get(_BATCH) == "10000" and not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def key_rows(spark: SparkSession) -> int:
    """``spark.topicwell.llm.keyRows`` or the default; tests set it to 0 to take the shuffled way."""
    return int(spark.conf.get("spark.topicwell.llm.keyRows", str(KEY_ROWS)))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> bool:
    """Whether a settled table of keys passes the size check for a broadcast."""
    spark = table.sparkSession

    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            held = F.octet_length(field.name)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            held = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            held = F.lit(8)
        return F.coalesce(held, F.lit(0))

    width = reduce(lambda a, b: a + b, map(size, table.schema))
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return found.n <= key_rows(spark) and (found.b or 0) <= KEY_BYTES


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def having(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_anti``: is not) in the settled table ``keys``; null equals null.

    All columns of ``keys`` are the key. A checked small table is broadcast, so ``df`` is not
    shuffled; a larger one is joined by a shuffle whose large partitions Spark splits.
    """
    names = keys.columns
    right = keys.toDF(*[f"_k_{c}" for c in names])
    if small(keys):
        right = F.broadcast(right)
    return df.join(right, same([F.col(c) for c in names], [F.col(f"_k_{c}") for c in names]), how)


def beside(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``df`` with a settled ``table`` that has one row per ``key``.

    While the keys pass the size check only the rows that have a partner are shuffled.
    """
    names = [c for c in table.columns if c != key]
    right = table.withColumnRenamed(key, f"_k_{key}")
    match = F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    keys = table.select(key)
    if not small(keys):
        return df.join(right, match, "left").drop(f"_k_{key}")
    hit = having(df, keys).join(right, match, "inner").drop(f"_k_{key}")
    miss = having(df, keys, "left_anti").select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names])
    return hit.unionByName(miss)


def parts(df: DataFrame, rows_each: int, rows: int | None = None) -> int:
    """How many groups of about ``rows_each`` rows a settled table makes."""
    return max(1, -(-(df.count() if rows is None else rows) // rows_each))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add dense numbers from 0 in the given total order without a one-task window.

    Rows are range partitioned and sorted; the offset of a partition comes from the counts of
    the partitions before it, a table of one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = settle(ranged, "numbered")
    part = F.shiftright("_m", 33)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    whole = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_p", "_c")))).alias("m"))
    offsets = whole.select(
        F.explode(
            F.transform(
                F.map_keys("m"),
                lambda p: F.struct(
                    p.alias("_p"),
                    F.aggregate(
                        F.map_entries("m"),
                        F.lit(0).cast("bigint"),
                        lambda acc, e: acc + F.when(e["key"] < p, e["value"]).otherwise(F.lit(0)),
                    ).alias("_before"),
                ),
            )
        ).alias("o")
    ).select("o.*")
    out = ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable over undirected edges: ``id``, ``component`` for every id in an edge.

    Large-star and small-star steps in turn until nothing changes. A step groups by one end and
    keeps a minimum, which is combined before the shuffle, then joins it back; the join's large
    partitions can be split, so a star with a third of all edges does not sit in one task. Every
    step is written, so a lost executor costs one step at most.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = settle(edges.select(high.alias("u"), low.alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour is linked to the least id around.
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every id and its smaller neighbours are linked to the least of them.
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# Rows of a group on either side of one comparison.
SIDE = 1024


def cells(members: DataFrame, key: str, spread: str, side: int = SIDE) -> DataFrame:
    """Deal the members of each group into cells in which every pair of a group meets exactly once.

    A group of up to ``side`` rows is one cell. A larger one is salted into blocks by hash of
    ``spread``, and each pair of blocks is a cell, so no task holds a whole group: columns ``_low``
    and ``_high`` name the cell's blocks, ``_block`` the row's. A pair of rows in a cell of two
    blocks counts if the rows are from different blocks. Groups of one row are left out.
    """
    sizes = members.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    counted = members.join(sizes, F.col(key) == F.col("_k")).drop("_k")
    blocks = F.ceil(F.col("_n") / side).cast("bigint")
    dealt = counted.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64(spread), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    met = dealt.withColumn("_other", other)
    return met.select(
        *members.columns,
        F.least("_block", "_other").alias("_low"),
        F.greatest("_block", "_other").alias("_high"),
        "_block",
    )
