"""Running values per key, in order, without putting a whole key into one task.

A window over ``partitionBy(topic)`` sorts a whole topic in one task, and one topic may hold
a third of all rows. Keys above a row limit are therefore cut into *cells*: consecutive pieces
of the key's order, each below the limit. A running value is then the value inside the cell,
from an ordinary window, combined with what the earlier (or later) cells of the key carry over.

Cells are found by counting, level by level. A piece that is too large is divided into equal
steps of its first order column, or of its second where the first has a single value and no nulls, until no
piece is too large. A cell is named by its step numbers, one column per level, so cells of a key
sort like the rows in them. What is not divided at a level has step -1 there; a key below the
limit is not divided at all and needs no carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwell.plans.statistics import most_rows
from topicwell.session import broadcast_rows, fits, group_rows, settle, settle_with, table_size

WHOLE = -1
# Steps per piece, as a multiple of those needed if its rows were spread evenly.
STEPS = 4


@dataclass(frozen=True)
class Scan:
    """One running value: inside a cell, summed up per cell, and carried between cells."""

    name: str
    local: Callable[[WindowSpec], Column]
    summary: Column
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    # Whether the windows run against the order. Spark runs forward frames in linear time only.
    backward: bool = False
    # Whether the summary is the number of rows, which cutting has counted already.
    counts: bool = False
    # What ``local`` and ``summary`` read as column ``_pre_<name>``: a running value of its own over the same window.
    # ``carry_pre`` is the same for ``carry``, over the summaries.
    pre: Callable[[WindowSpec], Column] | None = None
    carry_pre: Callable[[Column, WindowSpec], Column] | None = None


def _upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def count_before(name: str) -> Scan:
    """Number of earlier rows of the key: dense numbers from 0."""
    return Scan(
        name,
        lambda w: F.row_number().over(w).cast("bigint") - 1,
        F.count(F.lit(1)),
        lambda s, w: F.sum(s).over(_before(w)),
        lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
        counts=True,
    )


def total(name: str, value: Column, through: bool = True) -> Scan:
    """Running sum of ``value``, with the row itself or (``through=False``) before it."""
    frame = _upto if through else _before
    return Scan(
        name,
        lambda w: F.sum(value).over(frame(w)),
        F.sum(value),
        lambda s, w: F.sum(s).over(_before(w)),
        lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    )


def lowest(name: str, value: Column, through: bool = True) -> Scan:
    """Running minimum of ``value``, with the row itself or (``through=False``) before it."""
    frame = _upto if through else _before
    return Scan(
        name,
        lambda w: F.min(value).over(frame(w)),
        F.min(value),
        lambda s, w: F.min(s).over(_before(w)),
        lambda carry, local: F.least(carry, local),
    )


def lifted(name: str, change: Column) -> Scan:
    """Running sum of ``change`` that goes on from zero wherever it would stay below: a queue's depth.

    The value is that before a row lifts it, so it is below zero where a row finds nothing to take.
    Steps compose as ``d -> max(d + sum, least)``, so a cell carries its sum and its lowest prefix.
    """
    pre = f"_pre_{name}"

    def local(w: WindowSpec) -> Column:
        low = F.min(F.col(pre)).over(_before(w))
        return F.struct(F.col(pre).alias("sum"), low.alias("low"))

    def carry(s: Column, w: WindowSpec) -> Column:
        low = F.min(F.col(f"_carrypre_{name}") + s["low"]).over(_before(w))
        return F.col(f"_carrypre_{name}") - F.least(F.lit(0), low)

    return Scan(
        name,
        local,
        F.struct(F.sum(change).alias("sum"), F.min(F.col(pre)).alias("low")),
        carry,
        lambda carry, local: local["sum"] + F.greatest(F.coalesce(carry, F.lit(0)), -local["low"]),
        pre=lambda w: F.sum(change).over(_upto(w)),
        carry_pre=lambda s, w: F.coalesce(F.sum(s["sum"]).over(_before(w)), F.lit(0)),
    )


def previous(name: str, value: Column, order: Sequence[str]) -> Scan:
    """The last non-null ``value`` of an earlier row."""
    place = F.when(value.isNotNull(), F.struct(*order))
    return Scan(
        name,
        lambda w: F.last(value, ignorenulls=True).over(_before(w)),
        F.max_by(value, place),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda carry, local: F.coalesce(local, carry),
    )


def following(name: str, value: Column, order: Sequence[str]) -> Scan:
    """The first non-null ``value`` of a later row."""
    place = F.when(value.isNotNull(), F.struct(*order))
    return replace(previous(name, value, order), summary=F.min_by(value, place), backward=True)


@dataclass(frozen=True)
class Cells:
    """How the large keys of one table are cut.

    ``levels`` holds the divided pieces with their rows and bytes, ``counted`` the pieces of each
    division, large ones included.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    levels: list[tuple[DataFrame, tuple[int, int]]] = field(default_factory=list)
    counted: list[DataFrame] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [f"_cell{i}" for i in range(len(self.levels))]

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the cell columns to every row.

        The divided pieces are few, so no row is shuffled; beyond the size check rows are joined by
        the key, and adaptive execution splits the partitions of large ones.
        """
        names = self.columns
        for depth, (level, size) in enumerate(self.levels):
            df = attach(df, level, [*self.keys, *names[:depth]], size)
            step = F.when(F.col("_n").isNotNull(), _step(df, self.order[0], self.order[1]))
            df = df.withColumn(names[depth], F.coalesce(step, F.lit(WHOLE).cast("bigint")))
            df = df.drop("_n", "_held", "_lo0", "_hi0", "_lo1", "_hi1", "_steps")
        return df

    def sizes(self) -> DataFrame:
        """``_n`` rows of every cell of the divided keys, as cutting has counted them."""
        names = self.columns
        parts = []
        for depth, pieces in enumerate(self.counted, 1):
            if depth < len(self.levels):
                # What the next level divides is counted there, cell by cell.
                on = [*self.keys, *names[:depth]]
                divided = self.levels[depth][0].select(*[F.col(c).alias(f"_d_{c}") for c in on])
                match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in on])
                pieces = pieces.join(divided, match, "left_anti")
            whole = [F.lit(WHOLE).cast("bigint").alias(c) for c in names[depth:]]
            parts.append(pieces.select(*self.keys, *names[:depth], *whole, "_n"))
        return reduce(DataFrame.unionByName, parts)


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], size: tuple[int, int] | None = None) -> DataFrame:
    """Left join on null-safe keys; broadcast if the rows and bytes of the table pass the size check.

    Beyond the check adaptive execution splits the partitions of large keys.
    """
    names = {c: f"_r_{c}" for c in on}
    small = fits(df.sparkSession, *(size or table_size(table)))
    table = table.select([F.col(c).alias(names.get(c, c)) for c in table.columns])
    if small:
        table = F.broadcast(table)
    if not on:
        return df.join(table, how="left")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in on])
    return df.join(table, match, "left").drop(*names.values())


def _step(df: DataFrame, first: str, second: str) -> Column:
    """Step number of a row inside its piece; never decreases along the order."""

    def bucket(name: str, lo: str, hi: str) -> Column:
        value, low, high = F.col(name), F.col(lo), F.col(hi)
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampNTZType):
            zero = F.expr("interval '0' second")
            return F.call_function("width_bucket", value - low, zero, high - low, F.col("_steps"))
        if isinstance(kind, T.TimestampType):
            value, low, high = F.unix_micros(value), F.unix_micros(low), F.unix_micros(high)
        span = F.try_subtract(high, low)

        def share(distance: Column, whole: Column) -> Column:
            return F.call_function("width_bucket", distance, F.lit(0.0), whole, F.col("_steps"))

        # The difference is exact unless it leaves the range of a bigint.
        near = share((value - low).cast("double"), span.cast("double"))
        wide = [c.cast("double") for c in (value, low, high)]
        return F.when(span.isNotNull(), near).otherwise(share(wide[0] - wide[1], wide[2] - wide[1]))

    # Nulls sort first, in step 0. One value beside nulls is one step of its own.
    by_first = F.when(F.col("_lo0") < F.col("_hi0"), bucket(first, "_lo0", "_hi0")).when(F.col(first).isNotNull(), 1)
    by_second = bucket(second, "_lo1", "_hi1")
    return F.coalesce(F.when(_divided_by_first(), by_first).otherwise(by_second), F.lit(0))


def _divided_by_first() -> Column:
    """Whether the first order column tells rows of a piece apart: several values, or one and nulls."""
    return (F.col("_lo0") < F.col("_hi0")) | ((F.col("_held") > 0) & (F.col("_held") < F.col("_n")))


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> Cells:
    """Find the cells of ``df``. One counting pass, and one more per level of division.

    Nothing is counted if the footers of its files hold no more rows than one key may have. A pass writes the pieces; what else is asked of them is read from there.

    Any table may be counted that holds at least the rows the cells are used on. The first two
    order columns are numbers or timestamps. The limit rises with the rows of the large keys, so
    that all cells together stay within what may be broadcast.
    """
    spark = df.sparkSession
    rows = rows or group_rows(spark)
    first, second = order[0], order[1]
    cells = Cells(tuple(keys), tuple(order))
    known = most_rows(df)
    if known is not None and known <= rows:
        return cells
    slim = df.select(*{*keys, first, second})
    stats = [
        F.count(F.lit(1)).alias("_n"),
        F.count(first).alias("_held"),
        F.min(first).alias("_lo0"),
        F.max(first).alias("_hi0"),
        F.min(second).alias("_lo1"),
        F.max(second).alias("_hi1"),
    ]
    divisible = F.coalesce(_divided_by_first(), F.lit(False)) | F.coalesce(F.col("_lo1") < F.col("_hi1"), F.lit(False))
    pieces = slim.groupBy(*keys).agg(*stats)
    large, found = settle_with(pieces.where((F.col("_n") > rows) & divisible), **_extent(F.lit(True)))
    raised = -(-(found["held"] or 0) * 2 * STEPS // broadcast_rows(spark))
    if raised > rows:
        rows = raised
        large, found = settle_with(large.where(F.col("_n") > rows), **_extent(F.lit(True)))
    while found["count"]:
        steps = F.ceil(F.col("_n") * STEPS / rows).cast("bigint")
        cells.levels.append((large.withColumn("_steps", steps), (found["count"], found["bytes"] + 8 * found["count"])))
        kind = df.schema[first].dataType
        # A time with zone may stand for two instants as text, so its span is not used.
        if found["first"] is not None and not isinstance(kind, T.TimestampType):
            # The next pass reads no more of the files than the span of the large pieces.
            span = F.col(first).between(F.lit(found["first"]).cast(kind), F.lit(found["last"]).cast(kind))
            slim = slim.where(F.col(first).isNull() | span)
        inside = cells.assign(slim).where(F.col(cells.columns[-1]) != WHOLE)
        too_large = (F.col("_n") > rows) & divisible
        counted, found = settle_with(inside.groupBy(*keys, *cells.columns).agg(*stats), **_extent(too_large))
        cells.counted.append(counted)
        large = counted.where(too_large)
    return cells


def _extent(of: Column) -> dict[str, Column]:
    """Number, rows and span of the pieces that ``of`` marks."""
    return {
        "count": F.count(F.when(of, 1)),
        "held": F.sum(F.when(of, F.col("_n"))),
        "first": F.min(F.when(of, F.col("_lo0"))).cast("string"),
        "last": F.max(F.when(of, F.col("_hi0"))).cast("string"),
    }


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    cells: Cells | None = None,
) -> DataFrame:
    """Add the running values ``scans`` per key in order. ``order`` must be total and not random.

    Rows that already have the columns of ``cells`` keep them, and several calls share one shuffle.
    """
    own = cells is None
    cells = cells or cut(df, keys, order)
    columns = df.columns

    def windows(groups: Sequence[str], along: Sequence[str]) -> Callable[[Scan], WindowSpec]:
        groups_of = Window.partitionBy(*groups)
        forward = groups_of.orderBy(*along)
        backward = groups_of.orderBy(*[F.col(c).desc() for c in along])
        return lambda scan: backward if scan.backward else forward

    def prepared(rows: DataFrame, rows_of: Callable[[Scan], WindowSpec]) -> DataFrame:
        pre = [s.pre(rows_of(s)).alias(f"_pre_{s.name}") for s in scans if s.pre]
        return rows.select("*", *pre) if pre else rows

    if not cells.levels:
        rows_of = windows(keys, order)
        nothing = F.lit(None)
        return prepared(df, rows_of).select(*columns, *[s.merge(nothing, s.local(rows_of(s))).alias(s.name) for s in scans])

    names = cells.columns
    rows_of = windows([*keys, *names], order)
    rows = prepared(df if names[0] in columns else cells.assign(df), rows_of)
    if own and all(s.counts for s in scans):
        summary = cells.sizes().select(*keys, *names, *[F.col("_n").alias(f"_sum_{s.name}") for s in scans])
    else:
        summary = (
            rows.where(F.col(names[0]) != WHOLE)
            .groupBy(*keys, *names)
            .agg(*[s.summary.alias(f"_sum_{s.name}") for s in scans])
        )
    cells_of = windows(keys, names)
    pre = [s.carry_pre(F.col(f"_sum_{s.name}"), cells_of(s)).alias(f"_carrypre_{s.name}") for s in scans if s.carry_pre]
    summary = summary.select("*", *pre)
    carries = [s.carry(F.col(f"_sum_{s.name}"), cells_of(s)).alias(f"_carry_{s.name}") for s in scans]
    # One row per cell of the divided keys; ``cut`` bounds their number.
    carried = settle(summary.select(*keys, *names, *carries))
    inner = rows.select("*", *[s.local(rows_of(s)).alias(f"_local_{s.name}") for s in scans])
    joined = attach(inner, carried, [*keys, *names])
    merged = [s.merge(F.col(f"_carry_{s.name}"), F.col(f"_local_{s.name}")).alias(s.name) for s in scans]
    return joined.select(*columns, *merged)
