"""Repeated windows of a corpus: which symbols lie in a window of fixed width that occurs elsewhere.

A window takes the least hash of the grams in it as its *mark*. Equal windows have equal marks,
and neighbouring windows mostly share one, so a document is a list of runs of windows with one
mark each, about two runs per window width. The work on runs is:

1. marks are counted, after a count per task; marks that occur once end here;
2. runs of the remaining marks are grouped by mark and content. Runs with equal content are
   repeats as a whole. Groups are combined before the shuffle;
3. where one mark has runs of different content or is tied, every different run is compared window by window
   by the operator's own ``compare`` (suffix sorting or factoring), grouped by mark. A mark with more
   than ``WIDE`` symbols in different runs is not compared in a task: its windows are counted by mark
   and 128-bit digest, combined before the shuffle, and the verdict is joined back to the windows;
4. the verdict of each run content is joined back to all its places, and each text is cut once.

No step needs all rows of a mark, a document group or a copy group in one task. Rows are told apart by id and a hash of the
text (``row_key``), and what is gathered for a text is gathered under both, so rows without id, or with an id in common, do not
meet. Rows alike in both are documents of their own that lose the same symbols; their ranges are gathered once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import beside, bounded_batches, having, settle

SEGMENT = 1 << 19
# Symbols that one task compares in step 3.
COMPARED = 1 << 20
# Symbols of one mark's different runs that a task compares, and windows listed in one Arrow batch.
WIDE = 1 << 18
LISTED = 1 << 15

Values = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` symbols, marked by grams of ``gram`` symbols."""

    width: int
    gram: int
    values: Values  # bytes and row bounds to symbol values and row bounds
    stored: str  # numpy type in which a run's symbols travel to the comparison
    raw: bool  # symbols are the bytes themselves

    @property
    def reach(self) -> int:
        """Grams in a window, and windows that hold one place's gram."""
        return self.width - self.gram + 1


def runs(values: np.ndarray, bounds: np.ndarray, spec: Windows):
    """Runs of windows with one mark: row, start in the row, windows, mark, content hash, tied.

    A run is tied if its mark is the hash of grams at two places of it; only then can a run hold
    two equal windows.

    Runs also end every ``SEGMENT`` symbols, which changes where runs are cut but not the result.
    """
    n = len(values)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(bounds[:-1], bounds[1:] - spec.width + 1), 1)
    np.add.at(change, bounds[1:], -1)
    fits = np.cumsum(change[:n]) == 0
    found = []
    for at in range(0, max(0, n - spec.width + 1), SEGMENT):
        part = values[at : at + SEGMENT + spec.width - 1]
        sums = A.prefix(part)
        hashes = A.grams(sums, spec.gram)
        marks = A.sliding(np.minimum, hashes, spec.reach)
        ok = fits[at : at + len(marks)]
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (marks[1:] == marks[:-1]))
        starts = np.flatnonzero(new)
        stops = np.append(np.flatnonzero(new | ~ok), len(marks))
        ends = stops[np.searchsorted(stops, starts, "right")]
        content = A.slices(sums, starts, ends + spec.width - 1)
        row = np.searchsorted(bounds, starts + at, "right") - 1
        # Places whose gram is the least of some window, and how many of them each run has.
        edge = np.zeros(spec.reach - 1, np.uint64)
        least = np.flatnonzero(hashes == A.sliding(np.maximum, np.concatenate((edge, marks, edge)), spec.reach))
        low, high = np.searchsorted(least, starts), np.searchsorted(least, ends + spec.reach - 1)
        inside = A.ragged(low, high - low)
        equal = hashes[least[inside]] == np.repeat(marks[starts], high - low)
        tied = np.bincount(np.repeat(np.arange(len(starts)), high - low), equal, len(starts)) > 1
        found.append((row, starts + at - bounds[row], ends - starts, marks[starts], content, tied))
    if not found:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2 + [np.empty(0, bool)]
    return [np.concatenate(x) for x in zip(*found)]


def keyed(docs: DataFrame) -> DataFrame:
    """``id`` and ``text`` with a key that tells texts under one id apart."""
    return docs.select("id", "text", F.xxhash64("text").alias("row_key"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return A.blocks(batch.column(1))


def _count_marks(spec: Windows):
    def count(batches):
        for batch in batches:
            marks = []
            for _, buffer, bounds in _texts(batch):
                _, _, _, mark, _, tied = runs(*spec.values(buffer, bounds), spec)
                marks += [mark, mark[tied]]
            mark, n = np.unique(np.concatenate(marks), return_counts=True) if marks else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(n.astype(np.int64))], ["mark", "n"])

    return count


def _list_runs(spec: Windows):
    def listed(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, buffer, bounds in _texts(batch):
                row, start, length, mark, content, tied = runs(*spec.values(buffer, bounds), spec)
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        batch.column(2).take(take),
                        # One number, as rows are shuffled: start, length up to SEGMENT, tied.
                        pa.array(start << 21 | length << 1 | tied),
                        pa.array(mark.view(np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    ["id", "row_key", "place", "mark", "content"],
                )

    return listed


def _fetch_runs(spec: Windows):
    """Symbols of the runs that a row is asked for."""

    def fetched(batches):
        for batch in batches:
            out: list[tuple] = []
            ids, texts, asked = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                own = asked[i].as_py()
                buffer = np.frombuffer((texts[i].as_py() or "").encode(), np.uint8)
                symbols = buffer if spec.raw else spec.values(buffer, np.array([0, len(buffer)]))[0]
                out += [
                    (a["mark"], a["content"], a["first"], a["n"], a["wide"], symbols[a["start"] : a["start"] + a["length"] + spec.width - 1].tobytes())
                    for a in own
                ]
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), ids.type, pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["mark", "content", "first", "n", "wide", "symbols"]
            )

    return fetched


def _list_windows(spec: Windows):
    """Every window of a run: its place in the run and a digest of its symbols."""
    item = np.dtype(spec.stored).itemsize

    def listed(batches):
        for batch in batches:
            row, off, digest = [], [], []

            def rows():
                take = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n).take(take) for n in ("mark", "content", "first", "n")],
                        pa.array(off, pa.int64()),
                        pa.array(digest, pa.binary()),
                    ],
                    ["mark", "content", "first", "n", "off", "window"],
                )

            for i, data in enumerate(batch.column("symbols")):
                data = data.as_py()
                for at in range(len(data) // item - spec.width + 1):
                    window = data[at * item : (at + spec.width) * item]
                    row.append(i)
                    off.append(at)
                    digest.append(hashlib.blake2b(window, digest_size=16).digest())
                    if len(row) == LISTED:
                        yield rows()
                        row, off, digest = [], [], []
            yield rows()

    return listed


def _join_windows(spec: Windows):
    """Places of hit windows in a run to covered symbols."""

    def joined(batches):
        for batch in batches:
            parts = []
            for places in batch.column(2):
                at = np.sort(np.array(places.as_py(), np.int64))
                parts.append([{"off": int(a), "len": int(b - a)} for a, b in zip(*A.merged(at, at + spec.width))])
            kind = pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, kind)], ["mark", "content", "parts"]
            )

    return joined


def _wide_parts(symbols: DataFrame, spec: Windows, kind: str, held: Column) -> DataFrame:
    """What ``_compared`` gives, for runs of marks that no task can hold."""
    listed = f"mark bigint, content bigint, first {kind}, n bigint, off bigint, window binary"
    windows = settle(symbols.mapInArrow(_list_windows(spec), listed), "windows")
    held_by = windows.groupBy("mark", "window").agg(F.sum("n").alias("total"), F.min("first").alias("least"))
    again = settle(held_by.where(F.col("total") >= 2), "again")
    hits = windows.join(again.hint("merge"), ["mark", "window"]).where(held)
    return hits.groupBy("mark", "content").agg(F.collect_list("off").alias("places")).mapInArrow(
        _join_windows(spec), "mark bigint, content bigint, parts array<struct<off:bigint,len:bigint>>"
    )


def _compared(spec: Windows, compare):
    def run(table: pa.Table) -> pa.Table:
        data, bounds = A.column_buffer(table.column("symbols"))
        item = np.dtype(spec.stored).itemsize
        symbols = data[bounds[0] : bounds[-1]].copy().view(spec.stored)
        bounds = (bounds - bounds[0]) // item
        first = table.column("first").to_pylist()
        again = table.column("n").to_numpy() >= 2
        hit = compare(symbols, bounds, first, again, spec.width)
        # Windows to covered symbols, as ranges from the run's start.
        at = np.flatnonzero(hit)
        row = np.searchsorted(bounds, at, "right") - 1
        starts, ends = A.merged(at + row, at + row + spec.width)  # a gap of one between rows
        owner = row[np.searchsorted(at + row, starts)]
        starts, ends = starts - owner, ends - owner
        kept = np.unique(row)
        cut = np.searchsorted(owner, kept), np.searchsorted(owner, kept, "right")
        ranges = [
            [{"off": int(s - bounds[k]), "len": int(e - s)} for s, e in zip(starts[a:b], ends[a:b])]
            for k, a, b in zip(kept, *cut)
        ]
        take = pa.array(kept)
        return pa.table(
            {
                "mark": table.column("mark").take(take),
                "content": table.column("content").take(take),
                "parts": pa.array(ranges, pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64())]))),
            }
        )

    return run


def removed_ranges(
    docs: DataFrame, spec: Windows, compare, whole: Column, partly: Column, joins: Column, held: Column
) -> DataFrame:
    """For each text that loses symbols: ``key`` (id and row_key) and ``ranges``, an array of (start, end).

    ``docs`` has the columns ``id`` and ``text``. Over the columns ``id``, ``first`` (least id with
    this run content) and ``n`` (places of it): ``whole`` says that all windows of a run are hits,
    ``partly`` that the comparison decides. ``joins``, over ``n``, says which run contents have to
    be looked up at all. ``compare`` marks the windows of different runs that are hits; ``held`` says the same
    of one window, over ``first`` of its run, and ``total`` (places) and ``least`` (id) of all equal windows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["id"]
    texts = docs
    docs = keyed(docs)
    marks = texts.select("id", "text").mapInArrow(_count_marks(spec), "mark bigint, n bigint")
    again = settle(marks.groupBy("mark").agg(F.sum("n").alias("n")).where(F.col("n") >= 2).select("mark"), "marks")
    listed = docs.mapInArrow(
        _list_runs(spec),
        f"id {kind}, row_key bigint, place bigint, mark bigint, content bigint",
    )
    # The marks grow with the corpus, so they are never broadcast.
    length = F.shiftright("place", 1).bitwiseAND(F.lit((1 << 20) - 1))
    places = settle(
        listed.join(again.hint("merge"), "mark", "left_semi").select(
            "id",
            "row_key",
            F.shiftright("place", 21).alias("start"),
            length.alias("length"),
            "mark",
            "content",
            (F.col("place") % 2 == 1).alias("tied"),
        ),
        "runs",
    )
    contents = settle(
        places.groupBy("mark", "content").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("id").alias("first"),
            F.min(F.struct("id", "row_key", "start", "length")).alias("place"),
            F.max("tied").alias("tied"),
        ),
        "contents",
    )
    mixed = settle(
        contents.groupBy("mark").agg(
            F.count(F.lit(1)).alias("kinds"),
            F.max("tied").alias("tied"),
            (F.sum(F.col("place.length") + spec.width) > WIDE).alias("wide"),
        ).where((F.col("kinds") >= 2) | F.col("tied")).select("mark", "wide"),
        "mixed",
    )
    wanted = contents.join(mixed, "mark")
    asked = settle(
        wanted.groupBy(F.col("place.id").alias("id"), F.col("place.row_key").alias("row_key")).agg(
            F.collect_list(
                F.struct("place.start", "place.length", "mark", "content", "first", "n", "wide")
            ).alias("asked")
        ),
        "asked",
    )
    size = asked.select(F.explode("asked").alias("a")).select(F.col("a.length").alias("l"), F.col("a.wide").alias("wide")).agg(
        F.sum(F.when(~F.col("wide"), F.col("l") + spec.width)).alias("amount"), F.max("wide").alias("wide")
    ).first()
    groups = F.lit(max(1, -(-(size.amount or 0) // COMPARED)))
    right = asked.withColumnRenamed("id", "_id").withColumnRenamed("row_key", "_key")
    keys = asked.select("id", "row_key")
    held_texts = having(docs, keys)
    if held_texts.count() > asked.count():  # rows alike in id and text: one of them is looked at
        held_texts = held_texts.dropDuplicates(["id", "row_key"])
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
    texts = held_texts.join(right, match).select("id", "text", "asked")
    symbols = texts.mapInArrow(
        _fetch_runs(spec), f"mark bigint, content bigint, first {kind}, n bigint, wide boolean, symbols binary"
    )
    if size.wide:
        symbols = settle(symbols, "symbols")
    narrow = symbols.where(~F.col("wide")).withColumn("_group", F.pmod(F.xxhash64("mark"), groups))
    parts = narrow.groupBy("_group").applyInArrow(
        _compared(spec, compare), "mark bigint, content bigint, parts array<struct<off:bigint,len:bigint>>"
    )
    if size.wide:
        parts = parts.unionByName(_wide_parts(symbols.where("wide"), spec, kind, held))
    parts = settle(parts, "parts")
    verdicts = (
        contents.select("mark", "content", "n", "first")
        .join(parts, ["mark", "content"], "left")
        .where(joins | F.col("parts").isNotNull())
    )
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("off"), (F.col("length") + spec.width - 1).alias("len")))
    cut = F.when(whole, every).when(partly, F.col("parts"))
    found = (
        places.join(verdicts, ["mark", "content"])
        .select(F.struct("id", "row_key").alias("key"), "start", F.explode(cut).alias("p"))
        .groupBy("key")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("start") + F.col("p.off")).alias("start"),
                    (F.col("start") + F.col("p.off") + F.col("p.len")).alias("end"),
                )
            ).alias("ranges")
        )
    )
    return settle(found, "ranges")


def own_ranges(ranges: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The merged ranges of one text."""
    own = np.array([(r["start"], r["end"]) for r in ranges or []], np.int64).reshape(-1, 2)
    return A.merged(own[:, 0], own[:, 1])


def cut_texts(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the ranges found for it, or null."""
    rows = keyed(docs).select("id", "text", F.struct("id", "row_key").alias("key"))
    return beside(rows, ranges, "key").select("id", "text", "ranges")
