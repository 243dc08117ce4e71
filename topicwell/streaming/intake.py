"""File streams and how they are started."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from topicwell.operators.validation import file_atomic_accept, typed_ticks, with_reason
from topicwell.plans.joins import keyed_join
from topicwell.schemas import TICK_FILE, TICK_TEXT
from topicwell.session import scratch_scope, settle, settle_table
from topicwell.streaming.batches import commit_batch, prepare, read_batches, write_batch


def stream_ticks_csv(spark: SparkSession, folder: str, max_files: int | None = None, typed: bool = True) -> DataFrame:
    """The ``*.csv`` tick files of a folder as they arrive, with their path as ``file``; ``max_files`` bounds one intake.

    ``typed=False`` keeps the text, as ``stream_accept_files`` wants it.
    """
    reader = spark.readStream.schema(TICK_FILE if typed else TICK_TEXT).option("header", True).option("pathGlobFilter", "*.csv")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(folder).select("*", F.col("_metadata.file_path").alias("file"))


def stream_parquet(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


Trigger = Mapping[str, Any]


def start_stream(writer: DataStreamWriter, checkpoint: str, trigger: Trigger | None = None) -> StreamingQuery:
    """Start a stream, which goes on from its checkpoint.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, such as ``{"processingTime": "5 seconds"}``;
    the stream then runs until it is stopped. Without one it takes what has arrived, and the call
    returns when that is done.
    """
    chosen = trigger or {"availableNow": True}
    query = writer.option("checkpointLocation", checkpoint).trigger(**chosen).start()
    if trigger is None:
        query.awaitTermination()
    return query


def start_batches(
    stream: DataFrame,
    work: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Trigger | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a stream that hands its batches to ``work``. What a batch settles on the way goes when it is done."""

    def scoped(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            work(batch, batch_id)

    return start_stream(stream.writeStream.outputMode(mode).foreachBatch(scoped), checkpoint, trigger)


def stream_accept_files(text: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None) -> StreamingQuery:
    """Take tick files whole or not at all.

    ``text`` is the stream of tick rows as text with their ``file``. A file is always part of one batch, so a
    batch judges its files: the typed rows of those without a bad row are accepted; all rows of the others are
    kept as text in a table of rejected ones, bad rows with their ``reason``.
    """
    accepted, rejected = f"{path}/accepted", f"{path}/rejected"
    name = StructField("file", StringType())
    prepare(text.sparkSession, accepted, StructType([*TICK_FILE, name]))
    prepare(text.sparkSession, rejected, StructType([*TICK_TEXT, name, StructField("reason", StringType())]))

    def take(batch: DataFrame, batch_id: int) -> None:
        judged = settle_table(with_reason(batch), "intake")
        bad = F.col("reason").isNotNull()
        whole = file_atomic_accept(judged, bad, row="timestamp").drop("reason")
        write_batch(typed_ticks(whole), accepted, batch_id)
        bad_files = settle(judged.where(bad).select("file").distinct())
        write_batch(keyed_join(judged, bad_files, ["file"], "left_semi", ["timestamp"]), rejected, batch_id)
        for table in (accepted, rejected):
            commit_batch(batch.sparkSession, table, batch_id)

    return start_batches(text, take, checkpoint, trigger)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of the files that ``stream_accept_files`` has taken."""
    return read_batches(spark, f"{path}/accepted").drop("batch_id")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files that it has not taken."""
    return read_batches(spark, f"{path}/rejected").drop("batch_id")
