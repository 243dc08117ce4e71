"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased, as a 128-bit digest.
Documents arrive in batches, those with the largest ids first. A batch is summed to one row per key. It
is then merged against the runs that earlier batches have left: a key that no run holds is fresh, and the
largest id of the batch that bears it is the one that keeps its lines. The fresh keys become the batch's
own run. When a level holds ``FANOUT`` runs they are compacted to one run of the next level, so a batch
meets a number of runs that grows with the logarithm of the batches.

Runs are tables in buckets by key, sorted inside, so the index is never shuffled again: the anti-join of
a batch reads batch and runs bucket by bucket. How many documents hold a key is summed over the batches
in the same buckets. Only keys held by enough documents are joined back to the documents that bear them,
and only documents that lose a line are joined to their text.

Defined cases: a null text is one empty line, as is an empty one; every row is a document of its own,
also if rows share an id or a text, and rows that share the largest id all keep their lines; a null id
is smaller than any other; an empty table gives an empty result; other columns are ignored. A line may be
of any length; a key is a digest of all of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell.llm.tables import beside, settle, small
from topicwell.session import fresh_path

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
BATCHES = 4
# Runs of a level that are compacted to one of the next.
FANOUT = 3
# Keys of one bucket, about. A bucket is what one task merges.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS = 8
# Ids from which the batches' bounds are taken. They decide how large batches are, not what is found.
SAMPLE = 4096

KEY = ["high", "low"]
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """For every line of a text the digest of its key, or None if the key is shorter than ``least`` code points."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACE)
        short = len(key) < least or (not key.isascii() and len(key.decode()) < least)
        keys.append(None if short else hashlib.blake2b(key.translate(_LOWER), digest_size=16).digest())
    return keys


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _list_keys(least: int):
    """Each different key of a document, once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            digests: list[bytes] = []
            for i, text in enumerate(batch.column(1)):
                own = dict.fromkeys(k for k in line_keys((text.as_py() or "").encode(), least) if k)
                row += [i] * len(own)
                digests += own
            words = _words(digests)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(words[:, 0]), pa.array(words[:, 1])],
                ["bearer", *KEY],
            )

    return listed


def _cut_lines(least: int):
    """The lines of each document, and the text without those whose key it loses."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                total.append(text.count("\n") + 1)
                if lost.is_valid:
                    gone = {np.array([k["high"], k["low"]], np.int64).tobytes() for k in lost.as_py()}
                    keys = line_keys(text.encode(), least)
                    lines = [x for x, key in zip(text.split("\n"), keys) if key not in gone]
                    dropped.append(total[-1] - len(lines))
                    kept.append("\n".join(lines))
                else:
                    dropped.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_lines", "n_dropped", "kept_text"],
            )

    return cut


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class LineRuns:
    """Levelled sorted runs of the keys seen so far, each with the id that keeps its lines.

    The tables lie in the shared folder; ``close`` takes their names out of the session's catalog.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT) -> None:
        self.spark = spark
        self.buckets = buckets
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.counted: list[list[DataFrame]] = [[]]
        self._names: list[str] = []

    @property
    def runs(self) -> list[DataFrame]:
        """All runs, no key in two of them."""
        return [run for level in self.levels for run in level]

    def _written(self, df: DataFrame, kind: str) -> DataFrame:
        """``df`` as a table in sorted buckets by key."""
        name = f"llm_{kind}_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, *KEY)
        sorted_buckets = dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        sorted_buckets.option("path", fresh_path(self.spark, f"llm-{kind}")).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name)

    def _fresh(self, own: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds: a merge anti-join with one run after the other."""
        for run in self.runs:
            own = own.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return own

    def add(self, bearers: DataFrame) -> DataFrame:
        """Take a batch of ``bearer`` ids and keys. Gives its fresh keys with their ``keeper``.

        A batch's ids are not above those of the batches before.
        """
        own = bearers.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("bearer").alias("keeper"))
        own = self._written(own, "counts")
        fresh = self._written(self._fresh(own).select(*KEY, "keeper"), "run")
        self.counted[0].append(own.select(*KEY, "n"))
        self.levels[0].append(fresh)
        self._compact()
        return fresh

    def _compact(self) -> None:
        for depth, (runs, counts) in enumerate(zip(self.levels, self.counted)):
            if len(runs) < self.fanout:
                break
            if depth + 1 == len(self.levels):
                self.levels.append([])
                self.counted.append([])
            summed = _together(counts).groupBy(*KEY).agg(F.sum("n").alias("n"))
            self.levels[depth + 1].append(self._written(_together(runs), "run"))
            self.counted[depth + 1].append(self._written(summed, "counts"))
            runs.clear()
            counts.clear()

    def held_by(self, least: int) -> DataFrame:
        """Keys that at least ``least`` documents hold, with their ``keeper``."""
        counts = _together([c for level in self.counted for c in level])
        often = counts.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return _together(self.runs).join(often.hint("merge"), KEY).select(*KEY, "keeper")

    def close(self) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch_of(ids: DataFrame, batches: int) -> Column:
    """The batch of an ``id``: about equal shares of a sample, the largest ids first, nulls last."""
    sample = ids.where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    values = sorted((r.id for r in sample.collect()), reverse=True)
    cuts = sorted({values[len(values) * i // batches] for i in range(1, batches)}, reverse=True) if values else []
    number = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        number = F.when(F.col("id") > F.lit(cuts[i]), i).otherwise(number)
    return number.alias("batch")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``id_col, n_lines, n_dropped, kept_text``, one row per row of ``docs``.

    Keys of at least ``least_length`` code points that at least ``least_documents`` documents hold lose
    their lines, except in the documents with the largest id among these. Ids are numbers or texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    # Rows are told apart by id and text; rows alike in both lose the same lines.
    bearer = F.struct("id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"))
    marked = rows.withColumn("bearer", bearer)
    batch_of = _batch_of(rows.select("id"), batches)
    listed = marked.select("bearer", "text").mapInArrow(
        _list_keys(least_length), f"bearer struct<id:{kind},one:bigint,two:bigint>, high bigint, low bigint"
    )
    lines = settle(listed.select("bearer", F.col("bearer.id").alias("id"), *KEY).select("bearer", *KEY, batch_of), "lines")
    sizes = {r.batch: r.n for r in lines.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = LineRuns(spark, max(LEAST_BUCKETS, -(-max(sizes.values(), default=0) // BUCKET_ROWS)), fanout)
    try:
        for batch in sorted(sizes):
            runs.add(lines.where(F.col("batch") == batch).select(F.col("bearer.id").alias("bearer"), *KEY))
        losing = settle(runs.held_by(least_documents), "often") if sizes else None
    finally:
        runs.close()
    if losing is None:
        lost = lines.select("bearer", F.array(F.struct(*KEY)).alias("lost"))
    else:
        often = F.broadcast(losing) if small(losing) else losing
        below = (F.col("bearer.id") < F.col("keeper")) | (F.col("bearer.id").isNull() & F.col("keeper").isNotNull())
        lost = lines.join(often, KEY).where(below).groupBy("bearer").agg(F.collect_set(F.struct(*KEY)).alias("lost"))
    cut = beside(marked, settle(lost, "lost"), "bearer").select("id", "text", "lost")
    out = cut.mapInArrow(_cut_lines(least_length), f"id {kind}, n_lines bigint, n_dropped bigint, kept_text string")
    return out.withColumnRenamed("id", id_col)
