"""Joins that hold when one key has a third of the rows.

A broadcast is used only behind a count of the side it would send. Beyond that limit both sides
are shuffled, and keys with many rows on the left are spread over several join keys, with the
matching right rows repeated once per part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.plans.running import attach, previous, running, total
from topicwell.schemas import OPEN_END
from topicwell.session import broadcastable, fits, group_rows, settle, settle_table, settle_with, table_size


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    residual: Column | None = None,
) -> DataFrame:
    """Join ``left`` with the smaller ``right`` on equal keys and an optional further condition.

    ``how`` is one of ``inner``, ``left``, ``left_semi``, ``left_anti``. ``spread`` names left
    columns that tell the rows of one key apart. ``right`` should be settled: it is counted here.
    Columns of ``right`` other than the keys must not occur in ``left``.
    """
    keys = list(on)
    names = {c: f"_r_{c}" for c in keys}
    small = broadcastable(right)
    right = right.select([F.col(c).alias(names.get(c, c)) for c in right.columns])

    def match(*extra: Column) -> Column:
        condition = extra[0] if extra else F.lit(True)
        for c in keys:
            condition = condition & (F.col(c) == F.col(names[c]))
        return condition if residual is None else condition & residual

    if small:
        return left.join(F.broadcast(right), match(), how).drop(*names.values())

    limit = group_rows(left.sparkSession)
    # At most (left rows / limit) keys.
    large = settle(
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("bigint").alias("_parts"))
    )
    if large.isEmpty():
        return left.join(right, match(), how).drop(*names.values())
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = attach(left, large, keys).withColumn("_part", F.pmod(F.xxhash64(*spread), parts)).drop("_parts")
    right = attach(right, large.withColumnsRenamed(names), list(names.values()))
    right = right.withColumn("_r_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    joined = left.join(right, match(F.col("_part") == F.col("_r_part")), how)
    return joined.drop("_part", "_r_part", *names.values())


def _steps(
    intervals: DataFrame, lo: str, hi: str, first: str, last: str
) -> Callable[[Column], Column]:
    """A time step that never falls as time rises, about as long as the mean interval.

    ``first`` and ``last`` are the first and last start. Times outside are taken as these, so an
    interval without an end reaches the last step and no further. There are at most as many steps
    as keep the pieces of all intervals below ``PIECES`` times their number.
    """
    begin, end = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")

    def seconds(span: Column) -> Column:
        return span.cast("interval second").cast("decimal(20,6)").cast("double")

    def inside(value: Column) -> Column:
        return F.least(F.greatest(value, begin), end)

    mean = F.greatest(F.avg(seconds(inside(F.col(hi)) - F.col(lo))), F.lit(1e-6))
    # The table is known to be small; one partition spares a shuffle.
    steps = intervals.coalesce(1).agg(F.ceil(seconds(end - begin) / mean).alias("steps")).first().steps
    count = F.lit(max(int(steps), 1)).cast("bigint")
    zero = F.expr("interval '0' second")

    def step(value: Column) -> Column:
        bucket = F.call_function("width_bucket", inside(value) - begin, zero, end - begin, count)
        return F.coalesce(bucket, F.lit(0))

    return step


# A step is at least half the mean interval long, so n intervals of length L reach at most
# n * L / (L / 2) + 2 n steps.
PIECES = 4


def covered(
    points: DataFrame, intervals: DataFrame, key: str, point: str, number: str, lo: str, hi: str, how: str = "inner"
) -> DataFrame:
    """Join points with the intervals of the same key that hold them: ``lo <= point < hi``.

    Few intervals are cut at time steps and broadcast, so the points are not shuffled. Many are
    matched by the numbers of the points (``inner``) or by counting open intervals (``left_anti``).
    ``number`` is a bigint that rises with ``point`` inside a key, unique per point. ``intervals``
    are timestamps without zone. Each matching pair comes out once.

    Equal intervals count once, an interval without a key or a start holds nothing, and one without
    an end is open, whichever way the join goes.
    """
    open_end = F.coalesce(F.col(hi), F.lit(OPEN_END).cast("timestamp_ntz"))
    intervals = intervals.withColumn(hi, open_end).where(F.col(key).isNotNull() & (F.col(lo) < F.col(hi)))
    starts = {"first": F.min(lo).cast("string"), "last": F.max(lo).cast("string")}
    intervals, seen = settle_with(intervals.dropDuplicates(), **starts)
    if seen["first"] is None:
        return points if how == "left_anti" else points.join(intervals, key, "inner")
    rows, size = table_size(intervals)
    if fits(points.sparkSession, rows, PIECES * (size + 8 * rows)):
        step = _steps(intervals, lo, hi, seen["first"], seen["last"])
        pieces = intervals.withColumn("_step", F.explode(F.sequence(step(F.col(lo)), step(F.col(hi)))))
        match = (
            (F.col(key) == F.col("_r_key"))
            & (step(F.col(point)) == F.col("_step"))
            & (F.col(lo) <= F.col(point))
            & (F.col(point) < F.col(hi))
        )
        return points.join(F.broadcast(pieces.withColumnRenamed(key, "_r_key")), match, how).drop("_r_key", "_step")
    points = settle_table(points, "points")
    if how == "left_anti":
        return _uncovered(points, intervals, key, point, number, lo, hi)
    return _covered_runs(points, intervals, key, point, number, lo, hi)


def _covered_runs(
    points: DataFrame, intervals: DataFrame, key: str, point: str, number: str, lo: str, hi: str
) -> DataFrame:
    """Points are numbered in time order, so an interval is a run of numbers ``from .. to - 1``.

    Both ends are looked up by one running pass over points and ends together. The runs are then
    divided into blocks of numbers and joined by block, so work follows the size of the result.
    """
    order = ["_t", "_o"]
    spans = intervals.withColumn("_span", F.xxhash64(*intervals.columns))
    ends = spans.select(
        F.col(key), F.explode(F.array(lo, hi)).alias("_t"), F.struct(*spans.columns).alias("_row")
    )
    # Ends sort before points of the same time; the hash only tells equal ends apart.
    ends = ends.withColumn("_o", -1 - F.pmod(F.col("_row._span"), F.lit(2**62))).withColumn(
        "_number", F.lit(None).cast("bigint")
    )
    marks = points.select(
        F.col(key),
        F.col(point).alias("_t"),
        F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"),
        F.col(number).alias("_o"),
        F.col(number).alias("_number"),
    )
    both = marks.unionByName(ends)
    looked = running(both, [key], order, [previous("_last", F.col("_number"), order)])
    runs = (
        looked.where(F.col("_row").isNotNull())
        .groupBy(F.col("_row"))
        .agg(
            F.min(F.coalesce(F.col("_last") + 1, F.lit(0))).alias("_from"),
            F.max(F.coalesce(F.col("_last") + 1, F.lit(0))).alias("_to"),
        )
        .where(F.col("_from") < F.col("_to"))
        .select("_row.*", "_from", "_to")
        .drop("_span")
    )
    runs, seen = settle_with(runs, mean=F.avg(F.col("_to") - F.col("_from")))
    mean = seen["mean"] or 1
    block = F.lit(max(1, min(int(mean), 1024))).cast("bigint")
    wide = F.lit(1024).cast("bigint")

    def whole(value: Column, by: Column) -> Column:
        return F.call_function("div", value, by)

    # Two steps, so that a run over the whole log makes no large array.
    runs = runs.withColumn("_first", whole(F.col("_from"), block)).withColumn("_end", whole(F.col("_to") - 1, block))
    coarse = runs.withColumn("_wide", F.explode(F.sequence(whole(F.col("_first"), wide), whole(F.col("_end"), wide))))
    pieces = coarse.withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.greatest(F.col("_first"), F.col("_wide") * wide),
                F.least(F.col("_end"), F.col("_wide") * wide + wide - 1),
            )
        ),
    ).drop("_first", "_end", "_wide")
    numbered = points.withColumn("_block", whole(F.col(number), block))
    inside = (F.col(number) >= F.col("_from")) & (F.col(number) < F.col("_to"))
    joined = keyed_join(pieces, numbered, [key, "_block"], "inner", [*intervals.columns], inside)
    extra = [c for c in intervals.columns if c != key]
    return joined.select(*points.columns, *extra)


def _uncovered(
    points: DataFrame, intervals: DataFrame, key: str, point: str, number: str, lo: str, hi: str
) -> DataFrame:
    """Points at which no interval is open: opened minus closed so far is zero."""
    order = ["_t", "_o"]
    change = F.explode(
        F.array(
            F.struct(F.col(lo).alias("t"), F.lit(1).alias("d")),
            F.struct(F.col(hi).alias("t"), F.lit(-1).alias("d")),
        )
    ).alias("_c")
    changes = intervals.select(F.col(key), change).groupBy(key, F.col("_c.t").alias("_t")).agg(
        F.sum("_c.d").alias("_d")
    )
    changes = changes.withColumn("_o", F.lit(-1).cast("bigint")).withColumn(
        "_row", F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType)
    )
    marks = points.select(
        F.col(key),
        F.col(point).alias("_t"),
        F.lit(0).cast("bigint").alias("_d"),
        F.col(number).alias("_o"),
        F.struct(*points.columns).alias("_row"),
    )
    open_now = running(marks.unionByName(changes), [key], order, [total("_open", F.col("_d"))])
    return open_now.where(F.col("_row").isNotNull() & (F.col("_open") == 0)).select("_row.*")
