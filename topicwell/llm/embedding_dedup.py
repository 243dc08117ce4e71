"""Near-duplicate embeddings through a pivot permutation index.

The mean of a bounded sample is taken off, so that a direction shared by all vectors does not count.
Reference points (pivots) are chosen from the sample, each far from those before it. A vector is
described by its nearest pivots in their order. Every pivot has an inverted list of the vectors that
name it, divided into sections by a second pivot that they name too, so that a list with a third of
all vectors is many sections, and vectors that share two pivots meet in one.

Lists hold descriptions, not vectors. In a section the pivots that two members share are counted, and
their agreement is added up: the number of nearest pivots less the difference in rank, over the shared
ones. A pair with enough shared pivots and agreement is a candidate; one that also meets in an earlier
section counts there only. Vectors are then fetched for the members that have a candidate, and the
candidates are verified by cosine in double precision.

Equal vectors are one class, so copies make no pairs. Long sections are salted into blocks, and blocks
are compared by matrix products; what leaves a task is one row per vector with its number of links
and a root of its local links, not the pairs.

Recall is measured before lists are made, on pairs at the threshold exactly that are planted at the
sample, and on the links of sampled vectors in the whole table, of each vector the one with the least
cosine. The nearest pivots that describe a vector are raised until ``RECALL`` of both share two; then
the shared pivots and the agreement asked of a candidate are as many as leave that recall. If
``MOST_NEAREST`` pivots are not enough the pivots are halved; if that fails too, all vectors of that
length make one list in which all are candidates, which is exact: its work grows with the square of
the list, and a member is copied once per 1,024 others. What is hard to tell apart costs time, not links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers link with
nothing and form their own component; vectors of different length do not link; repeated rows are
vectors of their own; a component without any id has a null component id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm.links import LINKS, empty_links, link_batch, summed
from topicwell.llm.tables import bounded_batches, cells, parts, settle

THRESHOLD = 0.9
NEAREST, MOST_NEAREST = 7, 16
SAMPLE = 4096
FEWEST, MOST = 64, 1024
# Share of the measured pairs that have to meet in a list, and sampled vectors whose links are looked up.
RECALL = 0.99
PROBES = 1024
# Rows of one comparison task, about.
TASK_ROWS = 20_000


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _usable(value: list | None) -> np.ndarray | None:
    if not value or any(x is None for x in value):
        return None
    x = np.array(value, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _classes(batches):
    for batch in batches:
        keys, data = [], []
        for value in batch.column(1):
            x = _usable(value.as_py())
            raw = None if x is None else x.tobytes()
            keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            data.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["id", "class", "vector"]
        )


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: each pivot is as far as can be from those before it."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-12:
            break
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at])
    return vectors[chosen]


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions from the mean; those of vectors at the mean are zero."""
    x = x - mean
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0)


def nearest_pivots(x: np.ndarray, points: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each centred row, nearest first."""
    return np.argsort(-(x @ points.T), 1, kind="stable")[:, :nearest]


@dataclass(frozen=True)
class Index:
    """What describes vectors of one length."""

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int
    shared: int  # pivots that a candidate pair shares
    agreement: int  # and the least sum over them of ``nearest`` less the difference in rank


def pair_agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared pivots of the ordered pivots in each row of ``a`` and ``b``, and their agreement."""
    same = a[:, :, None] == b[:, None, :]
    rank = np.arange(a.shape[1])
    return same.sum((1, 2)), (same * (a.shape[1] - np.abs(rank[:, None] - rank))).sum((1, 2))


def section_agreement(near: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all members of the section of ``low`` and ``high``: shared pivots, agreement, and whether a pair meets earlier.

    A pair counts in the section of its two smallest shared pivots.
    """
    n, most = near.shape
    shared, agreement, earlier = np.zeros((n, n), np.int32), np.zeros((n, n), np.int32), np.zeros((n, n), bool)
    row, rank = np.nonzero(near >= 0)
    pivot = near[row, rank]
    order = np.argsort(pivot, kind="stable")
    row, rank, pivot = row[order], rank[order], pivot[order]
    edges = np.concatenate(([0], np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, [len(pivot)]))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        at = np.ix_(row[a:b], row[a:b])
        shared[at] += 1
        agreement[at] += most - np.abs(rank[a:b, None] - rank[a:b])
        if pivot[a] < high and pivot[a] != low:
            earlier[at] = True
    return shared, agreement, earlier


def planted(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x``, and partners at the threshold in directions in which rows differ."""
    rng = np.random.default_rng(0)
    side = x[rng.permutation(len(x))] - x[rng.permutation(len(x))]
    side -= (side * x).sum(1, keepdims=True) * x
    size = np.sqrt((side * side).sum(1))
    own = size > 1e-9
    x, side = x[own], side[own] / size[own, None]
    return x, threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * side


def choose_index(x: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], count: int, nearest: int) -> Index | None:
    """The most pivots, the fewest nearest of them and the strictest rule that find ``RECALL`` of each set of pairs."""
    mean = x.mean(0)
    points = choose_pivots(centred(x, mean), count)
    most = max(nearest, MOST_NEAREST)
    pairs = [(centred(a, mean), centred(b, mean)) for a, b in pairs if len(a)]
    while len(points) >= 2:
        orders = [(nearest_pivots(a, points, most), nearest_pivots(b, points, most)) for a, b in pairs]
        for number in range(nearest, most + 1):
            found = [pair_agreement(a[:, :number], b[:, :number]) for a, b in orders]

            def recall(shared: int, agreement: int) -> float:
                return min([((s >= shared) & (g >= agreement)).mean() for s, g in found], default=1)

            if recall(2, 0) >= RECALL:
                shared = max(c for c in range(2, number + 1) if c == 2 or found and recall(c, 0) >= RECALL)
                floor = max(f for f in range(number * number + 1) if f == 0 or found and recall(shared, f) >= RECALL)
                return Index(mean, points, number, shared, floor)
        points = points[: len(points) // 2]
    return None


def _hardest(probes: dict[int, np.ndarray], threshold: float):
    """Of each probe, the batch's link with the least cosine; copies and multiples do not count."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            data = batch.column(0).to_pylist()
            lengths = np.array([len(x) // 8 for x in data])
            for length in np.unique(lengths):
                own = probes.get(int(length))
                if own is None:
                    continue
                rows = np.flatnonzero(lengths == length)
                cosine = unit(np.array([np.frombuffer(data[r], np.float64) for r in rows])) @ own.T
                cosine[(cosine < threshold) | (cosine > 1 - 1e-9)] = 2
                least = cosine.argmin(0)
                for probe in np.flatnonzero(cosine.min(0) < 2):
                    out.append((int(length), int(probe), float(cosine[least[probe], probe]), data[rows[least[probe]]]))
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int32(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["length", "probe", "cosine", "vector"]
            )

    return run


def _described(indexes: dict[int, Index | None]):
    """The sections a vector is in, with its ordered pivots; a length without an index has one list."""

    def run(batches):
        for batch in batches:
            at, low, high, near = [], [], [], []
            data = batch.column(1).to_pylist()
            lengths = np.array([len(x) // 8 for x in data])
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                index = indexes.get(int(length))
                if index is None:
                    at += rows.tolist()
                    low += [-1] * len(rows)
                    high += [-1] * len(rows)
                    near += [[]] * len(rows)
                    continue
                x = unit(np.array([np.frombuffer(data[r], np.float64) for r in rows]))
                order = nearest_pivots(centred(x, index.mean), index.pivots, index.nearest)
                lists = order.tolist()
                for a, b in combinations(range(order.shape[1]), 2):
                    at += rows.tolist()
                    low += np.minimum(order[:, a], order[:, b]).tolist()
                    high += np.maximum(order[:, a], order[:, b]).tolist()
                    near += lists
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    pa.array(lengths[at] if at else [], pa.int32()),
                    pa.array(low, pa.int32()),
                    pa.array(high, pa.int32()),
                    pa.array(near, pa.list_(pa.int32())),
                ],
                ["class", "length", "low", "high", "near"],
            )

    return run


SECTION = ["length", "low", "high", "_low", "_high"]


def _sections(table: pa.Table, indexes: dict[int, Index | None]):
    """Sections of at least two rows in a sorted table: first row, end, and which pairs (each once) are candidates."""
    columns = {n: table.column(n).to_numpy() for n in [*SECTION, "_block"]}
    key = np.stack([columns[n] for n in SECTION])
    edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]))
    lists = table.column("near").combine_chunks()
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        candidate = np.triu(np.ones((b - a, b - a), bool), 1)
        if columns["_low"][a] != columns["_high"][a]:
            candidate &= columns["_block"][a:b, None] != columns["_block"][a:b]
        index = indexes.get(int(columns["length"][a]))
        if index is not None:
            near = values[starts[a] : starts[b]].reshape(b - a, -1)
            shared, agreement, earlier = section_agreement(near, columns["low"][a], columns["high"][a])
            candidate &= (shared >= index.shared) & (agreement >= index.agreement) & ~earlier
        yield a, b, candidate


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([(n, "ascending") for n in SECTION]).combine_chunks()


def _candidates(indexes: dict[int, Index | None]):
    """Members of sections that have a candidate."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table.drop_columns("_group"))
        kept = np.zeros(table.num_rows, bool)
        for a, b, candidate in _sections(table, indexes):
            kept[a:b] = candidate.any(0) | candidate.any(1)
        return table.filter(pa.array(kept))

    return run


def _verified(threshold: float, indexes: dict[int, Index | None]):
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        data = table.column("vector").combine_chunks()
        classes = table.column("class").combine_chunks()
        size = table.column("size").to_numpy()
        out = [empty_links()]
        for a, b, candidate in _sections(table, indexes):
            x = unit(np.array([np.frombuffer(v.as_py(), np.float64) for v in data[a:b]]))
            left, right = np.nonzero(candidate & (x @ x.T >= threshold))
            if len(left):
                out.append(link_batch(classes.slice(a, b - a), size[a:b], left, right))
        return pa.Table.from_batches(out)

    return run


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    sample: int = SAMPLE,
) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per row of ``vectors``."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["id"]
    known = settle(rows.mapInArrow(_classes, f"id {kind}, class binary, vector binary"), "vectors")
    classes = settle(
        known.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.first("vector").alias("vector")),
        "classes",
    )
    total = classes.count()
    few = [bytes(r.vector) for r in classes.orderBy("class").limit(sample).select("vector").collect()]
    count = int(min(MOST, max(FEWEST, total**0.5)))
    sampled = {}
    for length in {len(x) // 8 for x in few}:
        sampled[length] = unit(np.array([np.frombuffer(x, np.float64) for x in few if len(x) == 8 * length]))
    probes = {length: x[: max(1, PROBES * len(x) // len(few))] for length, x in sampled.items()}
    hardest = classes.select("vector").mapInArrow(
        _hardest(probes, threshold), "length int, probe int, cosine double, vector binary"
    ).groupBy("length", "probe").agg(F.min(F.struct("cosine", "vector")).alias("link")).collect()
    indexes = {}
    for length, x in sampled.items():
        links = [r for r in hardest if r.length == length]
        there = np.array([np.frombuffer(r.link.vector, np.float64) for r in links]).reshape(-1, length)
        linked = probes[length][[r.probe for r in links]], unit(there) if links else there
        indexes[length] = choose_index(x, [planted(x, threshold), linked], count, nearest)
    member = "class binary, length int, low int, high int, near array<int>"
    described = classes.select("class", "vector").mapInArrow(_described(indexes), member)
    listed = described.withColumn("_list", F.struct("length", "low", "high"))
    dealt = settle(cells(listed, "_list", "class").drop("_list"), "cells")

    def grouped(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("_group", F.pmod(F.xxhash64(*SECTION), F.lit(number)))

    met = grouped(dealt, parts(dealt, TASK_ROWS)).groupBy("_group").applyInArrow(
        _candidates(indexes), f"{member}, _low bigint, _high bigint, _block bigint"
    )
    met = settle(met, "candidates")
    fetched = met.join(classes.select("class", "size", "vector"), "class")
    found = grouped(fetched, parts(met, TASK_ROWS)).groupBy("_group").applyInArrow(_verified(threshold, indexes), LINKS)
    linked = summed(classes.drop("vector"), found)
    out = known.select("id", "class").join(linked.drop("first", "size"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
