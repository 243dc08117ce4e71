"""Tables written one micro-batch at a time, so that a repeated batch replaces itself.

A table has a ``schema`` and per batch its rows, a manifest and a commit:

- ``data/batch_id=K`` holds the rows of a batch, ``merged/A-B`` those of the batches ``A .. B``;
- ``manifest/K`` lists the folders that together hold all rows up to batch ``K``, so a read lists nothing else;
- ``index/A-B`` holds the first and last number of each topic in a folder, so a read from a number opens only the
  folders it needs;
- ``commits/batch_id=K`` is written last and holds the next number of the topics that the batch has touched. Every
  ``SNAPSHOT`` batches it holds those of all topics, so that no more than ``SNAPSHOT`` commits are read to find them.

When ``SNAPSHOT`` folders of one level have come together they are merged to one of the next, unless they are large
already. The number of folders therefore grows with the logarithm of the batches, or with the data. A merge is
part of its batch and is made again with it; the folders it replaces are deleted ``SNAPSHOT`` batches later,
when no reader that started before is likely to need them, and old manifests and commits with them.
Batch numbers have leading zeros, so that names sort like them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = 10
NUMBERS = "topic string, next bigint"
INDEX = "topic string, first bigint, last bigint"
# Folders of so many bytes are not merged any more.
MERGE_BYTES = 1024 * 1024 * 1024
# Batches after which manifests and commits are deleted.
KEPT = 3 * SNAPSHOT


@dataclass(frozen=True)
class Part:
    """A folder with the rows of the batches ``first .. last``."""

    first: int
    last: int
    level: int
    size: int
    indexed: bool

    @property
    def name(self) -> str:
        return f"{self.first:018d}-{self.last:018d}"

    @property
    def folder(self) -> str:
        return f"merged/{self.name}" if self.level else f"data/batch_id={self.first:018d}"


@dataclass(frozen=True)
class Manifest:
    """The folders of a table, and those that merges have replaced, with the batch of the merge."""

    parts: list[Part]
    replaced: list[tuple[int, str]]


def _folder(path: str, kind: str, batch_id: int) -> str:
    return f"{path}/{kind}/batch_id={batch_id:018d}"


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _matching(spark: SparkSession, pattern: str) -> list[JavaObject] | JavaObject:
    """The files of a pattern, sorted by name, without reading them."""
    files, place = _place(spark, pattern)
    return files.globStatus(place) or []


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, place = _place(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, place = _place(spark, path)
    if not files.exists(place):
        return None
    source = files.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def prepare(spark: SparkSession, path: str, columns: T.StructType) -> None:
    """Note the columns of a table before its first batch, so that it can be read when nothing has come."""
    if not _exists(spark, f"{path}/schema"):
        _write_text(spark, f"{path}/schema", columns.json())


def snapshot_of(batch_id: int) -> int:
    """The last batch up to this one that holds all that came before."""
    return batch_id - batch_id % SNAPSHOT


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(_folder(path, "data", batch_id))


def next_numbers(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """``(topic, next)`` as the batches before left it."""
    if batch_id == 0:
        return spark.sql("SELECT CAST(NULL AS STRING) AS topic, CAST(NULL AS BIGINT) AS next").where(F.lit(False))
    folders = [_folder(path, "commits", i) for i in range(snapshot_of(batch_id - 1), batch_id)]
    before = spark.read.schema(f"{NUMBERS}, done boolean").parquet(*folders)
    return before.where(F.col("done").isNull()).groupBy("topic").agg(F.max("next").alias("next"))


def commit_batch(
    spark: SparkSession,
    path: str,
    batch_id: int,
    written: DataFrame | None = None,
    before: DataFrame | None = None,
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    forget: int | None = None,
) -> None:
    """Mark a batch as written. ``written`` is the ``(topic, next)`` of its own topics, ``before`` that of all.

    ``partition_by`` and ``order`` say how merged folders are laid out. A table whose batches hold all that is
    still needed forgets those before ``forget`` instead.
    """
    if written is not None and before is not None:
        known = before.withColumnRenamed("next", "first")
        numbers = written.join(known, "topic", "left").select(
            "topic", F.coalesce("first", F.lit(0)).alias("first"), (F.col("next") - 1).alias("last")
        )
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{batch_id:018d}-{batch_id:018d}")
    _write_manifest(spark, path, batch_id, before is not None, partition_by, order, forget)
    commit = spark.sql("SELECT CAST(NULL AS STRING) AS topic, CAST(NULL AS BIGINT) AS next, true AS done")
    if written is not None:
        if before is not None and batch_id == snapshot_of(batch_id):
            written = before.unionByName(written).groupBy("topic").agg(F.max("next").alias("next"))
        commit = commit.unionByName(written, allowMissingColumns=True)
    commit.write.mode("overwrite").parquet(_folder(path, "commits", batch_id))
    _write_text(spark, f"{path}/last", str(batch_id))


def _manifest(spark: SparkSession, path: str, batch_id: int) -> Manifest:
    text = _read_text(spark, f"{path}/manifest/{batch_id:018d}") if batch_id >= 0 else None
    if text is None:
        return Manifest([], [])
    held = json.loads(text)
    return Manifest([Part(**p) for p in held["parts"]], [(at, folder) for at, folder in held["replaced"]])


def _write_manifest(
    spark: SparkSession,
    path: str,
    batch_id: int,
    indexed: bool,
    partition_by: Sequence[str],
    order: Sequence[str],
    forget: int | None,
) -> None:
    """The manifest of a batch from the one before, with the merges that are due."""
    earlier = _manifest(spark, path, batch_id - 1)
    parts, replaced = list(earlier.parts), []
    for at, folder in earlier.replaced:
        if at + SNAPSHOT <= batch_id:
            _delete(spark, f"{path}/{folder}")
        else:
            replaced.append((at, folder))
    folder = _folder(path, "data", batch_id)
    if _exists(spark, folder):
        parts.append(Part(batch_id, batch_id, 0, _size(spark, folder), indexed))
    gone = [p for p in parts if forget is not None and p.last < forget]
    while forget is None:
        tail = parts[-SNAPSHOT:]
        if len(tail) < SNAPSHOT or len({p.level for p in tail}) > 1 or max(p.size for p in tail) >= MERGE_BYTES:
            break
        parts[-SNAPSHOT:] = [_merge(spark, path, tail, partition_by, order)]
        gone += tail
    parts = [p for p in parts if p not in gone]
    replaced += [(batch_id, p.folder) for p in gone]
    replaced += [(batch_id, f"index/{p.name}") for p in gone if p.indexed]
    text = json.dumps({"parts": [asdict(p) for p in parts], "replaced": replaced})
    _write_text(spark, f"{path}/manifest/{batch_id:018d}", text)
    if batch_id >= KEPT:
        _delete(spark, f"{path}/manifest/{batch_id - KEPT:018d}")
        _delete(spark, _folder(path, "commits", batch_id - KEPT))


def _size(spark: SparkSession, folder: str) -> int:
    files, place = _place(spark, folder)
    return files.getContentSummary(place).getLength()


def _merge(spark: SparkSession, path: str, parts: list[Part], partition_by: Sequence[str], order: Sequence[str]) -> Part:
    merged = Part(parts[0].first, parts[-1].last, parts[0].level + 1, 0, all(p.indexed for p in parts))
    rows = _read_parts(spark, path, parts).hint("rebalance", *partition_by)
    rows = rows.sortWithinPartitions(*partition_by, *order) if partition_by or order else rows
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{merged.folder}")
    if merged.indexed:
        index = read_index(spark, path, parts).groupBy("topic").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{merged.name}")
    return Part(**{**asdict(merged), "size": _size(spark, f"{path}/{merged.folder}")})


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The latest committed batch. A note says where to look; the commits decide."""
    noted = _read_text(spark, f"{path}/last") or ""
    if noted.isdigit():
        last = int(noted)
        while _exists(spark, f"{_folder(path, 'commits', last + 1)}/_SUCCESS"):
            last += 1
        return last
    done = _matching(spark, f"{path}/commits/batch_id=*/_SUCCESS")
    if not len(done):
        return None
    return int(done[len(done) - 1].getPath().getParent().getName().removeprefix("batch_id="))


def live_parts(spark: SparkSession, path: str) -> list[Part]:
    """The folders that hold the rows of all committed batches."""
    last = last_batch(spark, path)
    return [] if last is None else _manifest(spark, path, last).parts


def read_index(spark: SparkSession, path: str, parts: Sequence[Part]) -> DataFrame:
    """``topic, first, last`` of the given folders, with the last batch ``until`` of the folder."""
    tables = [
        spark.read.schema(INDEX).parquet(f"{path}/index/{p.name}").withColumn("until", F.lit(p.last).cast("bigint"))
        for p in parts
        if p.indexed
    ]
    return reduce(DataFrame.unionByName, tables)


def _read_parts(spark: SparkSession, path: str, parts: Sequence[Part]) -> DataFrame:
    columns = T.StructType.fromJson(json.loads(_read_text(spark, f"{path}/schema")))
    columns.add("batch_id", T.LongType())
    single = [f"{path}/{p.folder}" for p in parts if not p.level]
    tables = [spark.read.schema(columns).option("basePath", f"{path}/data").parquet(*single)] if single else []
    # A merged folder is its own base, below which are the folders of its partition columns.
    tables += [spark.read.schema(columns).parquet(f"{path}/{p.folder}") for p in parts if p.level]
    if not tables:
        return spark.createDataFrame([], columns)
    return reduce(DataFrame.unionByName, [t.select(*columns.names) for t in tables])


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The data of the committed batches ``first .. last`` with their ``batch_id``, as ``last`` has left them."""
    parts = [p for p in _manifest(spark, path, last).parts if p.last >= first]
    return _read_parts(spark, path, parts).where(F.col("batch_id").between(first, last))


def read_batches(spark: SparkSession, path: str, from_snapshot: bool = False) -> DataFrame:
    """The data of the committed batches, or of those from the last snapshot on."""
    last = last_batch(spark, path)
    if last is None:
        return _read_parts(spark, path, [])
    if from_snapshot:
        return read_range(spark, path, snapshot_of(last), last)
    return _read_parts(spark, path, live_parts(spark, path))


def read_numbers(spark: SparkSession, path: str, topic: str, first: int) -> DataFrame:
    """The folders in which a topic has numbers from ``first`` on; the caller filters their rows."""
    parts = live_parts(spark, path)
    indexed = [p for p in parts if p.indexed]
    if indexed:
        found = read_index(spark, path, indexed).where((F.col("topic") == topic) & (F.col("last") >= first))
        wanted = {r.until for r in found.select("until").collect()}
        parts = [p for p in parts if not p.indexed or p.last in wanted]
    return _read_parts(spark, path, parts)
