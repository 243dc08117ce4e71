"""Tick sources: CSV files and folders, and a SQL table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell.schemas import TICK_FILE, TICK_TEXT

# Fixed value: name of the tick table in a SQL database.
TICK_TABLE = "stock_prices_2"


def read_ticks_csv(
    spark: SparkSession, path: str | Sequence[str], typed: bool = True, folder: bool = True
) -> DataFrame:
    """Tick files with their file name. The header line is skipped and columns go by position.

    A folder gives its ``*.csv`` files; ``folder=False`` takes ``path`` whatever its name.
    ``typed=False`` keeps the text, as ``split_valid_ticks`` wants it.
    """
    reader = spark.read.schema(TICK_FILE if typed else TICK_TEXT).option("header", True)
    if folder:
        reader = reader.option("pathGlobFilter", "*.csv")
    return reader.csv(path).select("*", F.col("_metadata.file_name").alias("file"))


def jdbc_ticks(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    lower: int,
    upper: int,
    table: str = TICK_TABLE,
    partitions: int = 32,
) -> DataFrame:
    """The tick table of a SQL database, read in ranges of ``id``; filters are pushed down.

    Rows outside ``lower..upper`` are read too, by the first and the last range.
    """
    return spark.read.jdbc(
        url,
        table,
        column="id",
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties),
    )
