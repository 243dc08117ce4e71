"""Ticks made up for tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell.plans.running import running, total
from topicwell.schemas import MONEY

# Start and value ranges of generated ticks.
FIRST_SECOND = "2025-03-27 09:00:00"
MOST_TICKS_PER_SECOND = 30
PRICE_RANGE = (100, 200)
VOLUME_RANGE = (100, 10000)
QUOTE_DISTANCE = (0.1, 1.0)


def generate_ticks(
    spark: SparkSession, symbols: Sequence[str], n_rows: int, seed: int = 0, start: str = FIRST_SECOND
) -> DataFrame:
    """``n_rows`` ticks for each symbol; see ``generate_ticks_for``."""
    quota = spark.createDataFrame([(s, n_rows) for s in symbols], "stock_symbol string, n_rows bigint")
    return generate_ticks_for(quota, seed, start)


def generate_ticks_for(quota: DataFrame, seed: int = 0, start: str = FIRST_SECOND) -> DataFrame:
    """Ticks for a table ``(stock_symbol, n_rows)``: 1 to 30 per second from ``start`` on.

    All values are hashes of symbol, second, position and seed, so a lost task repeats them.
    """
    wanted = quota.select("stock_symbol", F.col("n_rows").cast("bigint").alias("n_rows"))

    def unit(*parts) -> Column:
        """A value in [0, 1) from the hash of ``parts``."""
        return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2**32)).cast("double") / F.lit(float(2**32))

    def seconds(scale: int) -> DataFrame:
        # Blocks of a million, then of a thousand seconds, so that no symbol makes a large array.
        need = F.ceil(F.col("n_rows") * scale / MOST_TICKS_PER_SECOND).cast("bigint")
        grid = wanted.where(F.col("n_rows") > 0).withColumn("need", need).withColumn("start", F.lit(0).cast("bigint"))
        for size in (1_000_000, 1_000, 1):
            last = F.least(F.col("need") - F.col("start"), F.lit(size * 1000 if size < 1_000_000 else 2**62)) - 1
            steps = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", last, F.lit(size)))
            grid = grid.withColumn("step", F.explode(steps))
            grid = grid.withColumn("start", F.col("start") + F.col("step") * size).drop("step")
            if size == 1_000:
                grid = grid.repartition("stock_symbol", "start")
        grid = grid.select("stock_symbol", "n_rows", F.col("start").alias("second"))
        count = 1 + F.floor(unit(F.lit("count"), "stock_symbol", "second") * MOST_TICKS_PER_SECOND)
        return grid.withColumn("ticks", count.cast("bigint"))

    # A second holds 15.5 ticks on average; more seconds are taken until every symbol has enough.
    scale = 3
    while True:
        grid = seconds(scale)
        short = (
            grid.groupBy("stock_symbol", "n_rows").agg(F.sum("ticks").alias("made")).where("made < n_rows")
        )
        if scale >= MOST_TICKS_PER_SECOND or short.isEmpty():
            break
        scale *= 2

    counted = running(
        grid, ["stock_symbol"], ["second", "second"], [total("before", F.col("ticks"), through=False)]
    )
    kept = F.least(F.col("ticks"), F.col("n_rows") - F.col("before"))
    ticks = counted.withColumn("kept", kept).where(F.col("kept") > 0)
    ticks = ticks.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("kept"))))

    def uniform(name: str, low: float, high: float) -> Column:
        return F.lit(low) + unit(F.lit(name), "stock_symbol", "second", "i") * (high - low)

    ticks = ticks.select(
        F.col("stock_symbol"),
        F.col("second"),
        F.round(uniform("price", *PRICE_RANGE), 2).cast(MONEY).alias("price"),
        F.floor(uniform("volume", VOLUME_RANGE[0], VOLUME_RANGE[1] + 1)).cast("int").alias("volume"),
        uniform("bid", *QUOTE_DISTANCE).alias("below"),
        uniform("ask", *QUOTE_DISTANCE).alias("above"),
    )
    ticks = ticks.withColumn("bid_price", F.round(F.col("price") - F.col("below"), 2).cast(MONEY))
    ticks = ticks.withColumn("ask_price", F.round(F.col("price") + F.col("above"), 2).cast(MONEY))
    time = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("second"))
    return ticks.select(
        time.alias("timestamp"),
        "stock_symbol",
        "price",
        "volume",
        "bid_price",
        "ask_price",
        (F.col("ask_price") - F.col("bid_price")).cast(MONEY).alias("spread"),
    )
