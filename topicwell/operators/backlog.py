"""Depth and bytes of one queue over a log of ``write`` and ``read`` operations.

Operations have ``seq``, ``ts`` and ``op`` and run in the order ``(ts, seq)``. A read of an empty
queue changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.joins import keyed_join
from topicwell.plans.running import Scan, lifted, running, total
from topicwell.session import settle_table

WRITE, READ = "write", "read"
_ORDER = ("ts", "seq")


def _relevant(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op").isin(WRITE, READ))


def _depths(ops: DataFrame, *scans: Scan) -> DataFrame:
    """Add ``depth`` and the values of ``scans``, in one pass over the operations."""
    change = F.when(F.col("op") == WRITE, 1).otherwise(-1)
    passed = running(ops, [], _ORDER, [lifted("_level", change), *scans])
    depth = F.greatest(F.col("_level"), F.lit(0)).cast("bigint")
    return passed.select(*ops.columns, depth.alias("depth"), *[s.name for s in scans])


def queue_depth(ops: DataFrame, capacity: int) -> DataFrame:
    """Depth after each operation; a queue of ``capacity`` slots is full at ``capacity - 1``."""
    depths = _depths(_relevant(ops).select("seq", "ts", "op"))
    return depths.select("seq", "ts", "op", "depth", (F.col("depth") >= capacity - 1).alias("at_capacity"))


def byte_backlog(ops: DataFrame, size: Column, section: int) -> DataFrame:
    """Bytes waiting after each operation, and their share of the data section in percent.

    The k-th read that finds something frees the bytes of the k-th write. What has been written and not
    been taken is the depth, so an operation knows how many writes have been freed, and the bytes of the
    first so many writes are known where the last of them is.
    """
    ops = _relevant(ops).select("seq", "ts", "op", size.cast("bigint").alias("size"))
    is_write = F.col("op") == WRITE
    turn = [
        total("_writes", F.when(is_write, 1).otherwise(0)),
        total("_bytes", F.when(is_write, F.col("size")).otherwise(0)),
    ]
    passed = _depths(ops, *turn).withColumn("_freed", F.col("_writes") - F.col("depth"))
    passed = settle_table(passed.drop("size"), "operations")
    upto = passed.where(is_write).select(F.col("_writes").alias("_freed"), F.col("_bytes").alias("_gone"))
    known = keyed_join(passed, upto, ["_freed"], "left", ["seq"])
    used = (F.col("_bytes") - F.coalesce("_gone", F.lit(0))).cast("bigint")
    waiting = known.select("seq", "ts", "op", used.alias("bytes_used"))
    return waiting.select("*", (F.col("bytes_used") * 100.0 / section).alias("pct"))
