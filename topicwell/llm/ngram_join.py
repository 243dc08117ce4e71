"""Similarity join on word n-grams with Bayesian pruning of candidates.

Documents are the sets of their shingles of ``size`` words; documents with equal sets are one class.
Classes that agree on a band of MinHash values are candidates. For each candidate pair the values
are compared a few at a time, and the pair is dropped as soon as the posterior probability of
reaching the threshold, given the matches so far and a uniform prior, falls below ``TOLERANCE``. The
pairs left are verified on their whole shingle sets.

A band's group is salted into blocks when it is large, each pair of blocks is one cell, and a pair
that agrees on several bands belongs to the first of them. A cell puts out the classes that still
have a pair and its pairs as packed positions; shingle sets are fetched for those classes only, and
a verified cell puts out links per class and local roots, never one row per pair.

With 30 bands of 5 values a pair at the threshold 0.8 is missed by the bands with probability
7e-6, and pruned with about 1e-5. Verification compares 64-bit shingle hashes.

Defined cases: null text has no words; a document without words links with nothing and is its own
class; fewer than ``size`` words make one shingle of all of them; repeated rows are documents of one
class; a class without any id has a null class id; an empty table gives an empty result; columns
beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.links import LINKS, empty_links, link_batch, summed
from topicwell.llm.tables import bounded_batches, cells, having, parts, settle

WORDS = 5
THRESHOLD = 0.8
BANDS, VALUES = 30, 5
STEP = 15
TOLERANCE = 1e-6
TASK_ROWS = 20_000
# Pairs that one row of candidates holds at most; a cell with more has several rows.
ROW_PAIRS = 1 << 16
VOCABULARY = 4096

_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 1 << 31, BANDS * VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * VALUES, dtype=np.uint32)


def shingles(buffer: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and the range of each row."""
    starts, ends, rows = A.words(buffer, bounds)
    values = A.word_values(buffer, starts, ends)
    words = np.diff(rows)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    sums = A.prefix(values)
    begin = A.ragged(rows[:-1], count)
    row = np.repeat(np.arange(len(words)), count)
    return A.slices(sums, begin, begin + np.minimum(words, size)[row]), np.concatenate(([0], np.cumsum(count)))


def _sets(buffer: np.ndarray, bounds: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    found, rows = shingles(buffer, bounds, size)
    return [np.unique(found[a:b]) for a, b in zip(rows[:-1], rows[1:])], found, rows


def _digest(shingle_set: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest() if len(shingle_set) else None


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            for row, buffer, bounds in A.blocks(batch.column(1)):
                sets, found, rows = _sets(buffer, bounds, size)
                n = len(sets)
                least = np.zeros((n, BANDS * VALUES), np.uint32)
                filled = np.flatnonzero(np.diff(rows))
                short = (found >> np.uint64(32)).astype(np.uint32)
                for j in range(BANDS * VALUES if len(filled) else 0):
                    least[filled, j] = np.minimum.reduceat(short * _MULTIPLY[j] + _ADD[j], rows[filled])
                bands = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(n, 0)
                for j in range(VALUES):
                    bands = A.mix(bands * np.uint64(A.BASE) + least[:, j::VALUES])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in A.mix(least.astype(np.uint64)).astype(np.uint8)], pa.binary()),
                    ],
                    ["id", "class", "bands", "sketch"],
                )

    return run


def least_matches(threshold: float, steps: list[int], tolerance: float) -> list[int]:
    """Matches needed after each number of values. A byte of a value also agrees by chance, 1 in 256.

    With a uniform prior the posterior of the agreement is Beta(m + 1, n - m + 1), and the chance
    that it reaches ``p`` is that of at most ``m`` successes in ``n + 1`` trials at ``p``.
    """
    p = threshold + (1 - threshold) / 256
    needed = []
    for n in steps:
        reach = 0.0
        for m in range(n + 2):
            reach += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if reach >= tolerance:
                needed.append(m)
                break
    return needed


def pruned_pairs(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that stay likely to reach the threshold while more and more values are compared."""
    ends = list(range(STEP, sketch.shape[1] + 1, STEP))
    matches = np.zeros(len(left), np.int64)
    for end, needed in zip(ends, least_matches(threshold, ends, TOLERANCE)):
        part = slice(end - STEP, end)
        matches += (sketch[left, part] == sketch[right, part]).sum(1)
        keep = matches >= needed
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _candidates(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        key = {n: table.column(n).to_numpy() for n in ("key", "_low", "_high")}
        order = np.lexsort([key[n] for n in ("_high", "_low", "key")])
        table = table.take(pa.array(order)).combine_chunks()
        low, high, block, band = (table.column(n).to_numpy() for n in ("_low", "_high", "_block", "band"))
        keys = np.stack([table.column("key").to_numpy(), low, high])
        cell = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(order), -1)
        lefts, rights = [], []
        for step in range(1, int(np.bincount(cell).max())):
            left = np.flatnonzero(cell[:-step] == cell[step:])
            right = left + step
            left, right = (x[(low[left] == high[left]) | (block[left] != block[right])] for x in (left, right))
            # The pair belongs to the first band on which it agrees.
            first = (bands[left] == bands[right]).argmax(1)
            own = first == band[left]
            left, right = pruned_pairs(sketch, left[own], right[own], threshold)
            lefts.append(left)
            rights.append(right)
        left = np.concatenate(lefts) if lefts else np.empty(0, np.int64)
        right = np.concatenate(rights) if rights else np.empty(0, np.int64)
        by_cell = np.argsort(cell[left], kind="stable")
        left, right = left[by_cell], right[by_cell]
        classes = table.column("class").to_pylist()
        out: list[tuple] = []
        edges = np.searchsorted(cell[left], np.arange(cell[-1] + 2))
        for a, b in zip(edges[:-1], edges[1:]):
            for start in range(a, b, ROW_PAIRS):
                stop = min(b, start + ROW_PAIRS)
                used, at = np.unique(np.concatenate((left[start:stop], right[start:stop])), return_inverse=True)
                pairs = at.reshape(2, -1).astype(np.int32)
                row = hashlib.blake2b(b"".join(classes[i] for i in used) + pairs.tobytes(), digest_size=16).digest()
                out.append((row, [classes[i] for i in used], pairs.tobytes()))
        columns = list(zip(*out)) or [[]] * 3
        types = [pa.binary(), pa.list_(pa.binary()), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["row", "classes", "pairs"])

    return run


def _shingle_sets(size: int):
    def run(batches):
        for batch in batches:
            for _, buffer, bounds in A.blocks(batch.column(0)):
                sets, _, _ = _sets(buffer, bounds, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["class", "shingles"],
                )

    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each pair."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    # Many pairs: products of the sets' indicator matrix, a part of the vocabulary at a time.
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[word] >= 2
    owner, word = owner[shared], np.unique(word[shared], return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(word.max(initial=-1)) + 1, VOCABULARY):
        a, b = np.searchsorted(word, [start, start + VOCABULARY])
        has = np.zeros((len(sets), VOCABULARY), np.float32)
        has[owner[a:b], word[a:b] - start] = 1
        common += has @ has.T
    return common[left, right].astype(np.int64)


def _verified(threshold: float):
    reach = Fraction(threshold).limit_denominator(10_000)

    def run(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i, r=table.column("row").to_pylist(), p=table.column("at").to_pylist(): (r[i], p[i]))
        table = table.take(pa.array(order, pa.int64())).combine_chunks()
        row = table.column("row").to_pylist()
        classes = table.column("class").combine_chunks()
        sizes = table.column("size").to_numpy()
        pairs = table.column("pairs").to_pylist()
        out, a = [empty_links()], 0
        while a < len(row):
            b = a + 1
            while b < len(row) and row[b] == row[a]:
                b += 1
            left, right = np.frombuffer(pairs[a], np.int32).reshape(2, -1).astype(np.int64)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")[a:b]]
            length = np.array([len(s) for s in sets])
            common = intersections(sets, left, right)
            linked = reach.denominator * common >= reach.numerator * (length[left] + length[right] - common)
            if linked.any():
                out.append(link_batch(classes.slice(a, b - a), sizes[a:b], left[linked], right[linked]))
            a = b
        return pa.Table.from_batches(out)

    return run


def ngram_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """``id_col, class_id, set_id, n_links, kept``, one row per row of ``docs``.

    ``class_id`` is the smallest id reachable by links, ``set_id`` the smallest id with the same
    shingles, ``n_links`` the number of other documents at the threshold or above, and ``kept`` says
    that the document is the one of its class that stays.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    known = settle(
        rows.mapInArrow(_sketches(size), f"id {kind}, class binary, bands array<bigint>, sketch binary"), "sketches"
    )
    classes = settle(
        known.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("size"), F.min("id").alias("first"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    members = classes.select("class", F.posexplode("bands").alias("band", "key"))
    shared = settle(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("key"), "bands")
    dealt = settle(cells(having(members, shared), "key", "class"), "cells")
    groups = F.lit(parts(dealt, TASK_ROWS))
    met = dealt.join(classes.select("class", "bands", "sketch"), "class").withColumn(
        "_group", F.pmod(F.xxhash64("key", "_low", "_high"), groups)
    )
    candidates = settle(
        met.groupBy("_group").applyInArrow(_candidates(threshold), "row binary, classes array<binary>, pairs binary"),
        "candidates",
    )
    asked = candidates.select("row", F.posexplode("classes").alias("at", "class"), "pairs").withColumn(
        "pairs", F.when(F.col("at") == 0, F.col("pairs"))
    )
    asked = settle(asked, "asked")
    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "size", "first")
    wanted = settle(wanted, "wanted")
    texts = having(rows, wanted.select(F.col("first").alias("id")).distinct()).select("text")
    sets = texts.mapInArrow(_shingle_sets(size), "class binary, shingles binary")
    sets = sets.where(F.col("class").isNotNull()).dropDuplicates(["class"])
    slots = F.lit(parts(asked, TASK_ROWS // 10))
    fetched = asked.join(wanted.join(sets, "class").drop("first"), "class").withColumn("_slot", F.pmod(F.xxhash64("row"), slots))
    found = fetched.groupBy("_slot").applyInArrow(_verified(threshold), LINKS)
    linked = summed(classes.select("class", "size", "first"), found)
    out = known.select("id", "class").join(linked.drop("size"), "class", "left")
    alone = F.col("class").isNull()
    class_id = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col),
        class_id.alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first")).alias("set_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.col("id").eqNullSafe(class_id).alias("kept"),
    )
