"""Repeated byte strings by suffix sorting with a difference cover.

``suffix_dedup`` removes every byte covered by a string of ``width`` bytes that starts anywhere
else too. Only strings whose mark occurs again can repeat (``repeats``); runs of equal content are
repeats as a whole, windows of marks too large for a task are counted by digest, and what is left is
suffix-sorted. Spark deals the remaining runs out by mark,
so equal strings meet in one task, and each task sorts its share with the difference cover
{1, 2} modulo 3: the triples at those places are sorted and named, names that are not unique are
sorted by recursion, the remaining third of the suffixes is ordered by one symbol and the rank that
follows, and the two orders are merged. Adjacent suffixes are then compared over ``width`` bytes.

Defined cases: null text is empty; repeated rows are documents of their own, so their strings occur
twice; ids may be null; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.repeats import Windows, cut_texts, own_ranges, removed_ranges

WIDTH = 200
GRAM = 64


def _byte_symbols(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A.byte_values(buffer), bounds


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One integer per row that sorts like the row of non-negative columns."""
    key = columns[0].astype(np.int64)
    bits = int(key.max(initial=0)).bit_length()
    for column in columns[1:]:
        width = max(1, int(column.max(initial=0)).bit_length())
        if bits + width > 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bits = int(key.max(initial=0)).bit_length()
        key = (key << width) | column
        bits += width
    return key


def _packed_alike(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    both = _packed(*[np.concatenate(pair) for pair in zip(left, right)])
    return both[: len(left[0])], both[len(left[0]) :]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of every suffix of positive symbols, in order; an ended suffix is the smaller."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    # A place past the end with a 1 modulo 3 keeps a one-place list from running into the next.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    cover = np.concatenate((ones, twos))
    triples = _packed(padded[cover], padded[np.minimum(cover + 1, n)], padded[np.minimum(cover + 2, n)])
    named, names = np.unique(triples, return_inverse=True)
    if len(named) < len(cover):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(order) + 1)
    sampled = cover[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_packed(padded[rest], rank[rest + 1]), kind="stable")]
    # How many sampled suffixes of either kind come before each of the others.
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    a, b = _packed_alike((padded[first], rank[first + 1]), (padded[rest], rank[rest + 1]))
    before = np.searchsorted(a, b)
    a, b = _packed_alike(
        (padded[second], padded[second + 1], rank[second + 2]), (padded[rest], padded[rest + 1], rank[rest + 2])
    )
    before = before + np.searchsorted(a, b)
    place = before + np.arange(len(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sampled
    return out


def repeated_windows(
    symbols: np.ndarray, bounds: np.ndarray, _: list, again: np.ndarray, width: int
) -> np.ndarray:
    """Starts of windows that another run holds too; a run marked ``again`` stands for several."""
    hit = np.zeros(len(symbols), bool)
    lengths = np.diff(bounds)
    starts = A.ragged(bounds[:-1], np.maximum(lengths - width + 1, 0))
    if not len(starts):
        return hit
    # A zero-like symbol after every run keeps runs apart; windows never reach it.
    spaced = np.zeros(len(symbols) + len(lengths), np.int64)
    shift = np.repeat(np.arange(len(lengths)), lengths)
    spaced[np.arange(len(symbols)) + shift] = symbols.astype(np.int64) + 2
    spaced[spaced == 0] = 1
    order = suffix_array(spaced)
    back = np.full(len(spaced), -1, np.int64)
    back[starts + shift[starts]] = starts
    order = back[order]
    order = order[order >= 0]
    # Eight bytes at every place, so that a window is compared in a few steps.
    padded = np.concatenate((symbols, np.zeros(8, np.uint8))).astype(np.uint64)
    eight = np.zeros(len(symbols), np.uint64)
    for i in range(8):
        eight |= padded[i : i + len(symbols)] << np.uint64(8 * i)
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for step in [*range(0, width - 7, 8), width - 8]:
        alive = alive[eight[left[alive] + step] == eight[right[alive] + step]]
    equal = np.zeros(len(order) + 1, bool)
    equal[alive + 1] = True  # equal[i]: order[i] has the same window as order[i - 1]
    group = np.cumsum(~equal[:-1]) - 1
    row = np.searchsorted(bounds, order, "right") - 1
    number = np.bincount(group, np.where(again[row], 2, 1))
    hit[order[number[group] >= 2]] = True
    return hit


def _cut_bytes(batches):
    for batch in batches:
        ids, texts, ranges = batch.column(0), batch.column(1), batch.column(2)
        kept, total, removed, spans = [], [], [], []
        for i in range(batch.num_rows):
            text = (texts[i].as_py() or "").encode()
            starts, ends = own_ranges(ranges[i].as_py())
            total.append(len(text))
            removed.append(int((ends - starts).sum()))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
            edges = np.concatenate(([0], np.stack((starts, ends), 1).ravel(), [len(text)]))
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "spans", "kept_bytes"],
        )


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """``id_col, n_bytes, n_removed, spans (byte ranges), kept_bytes``, one row per row of ``docs``."""
    if width < 8:
        raise ValueError("a width of at least 8 bytes is needed")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spec = Windows(width, gram, _byte_symbols, "uint8", True)
    twice = F.col("n") >= 2
    ranges = removed_ranges(rows, spec, repeated_windows, twice, ~twice, twice, F.col("total") >= 2)
    kind = dict(rows.dtypes)["id"]
    out = cut_texts(rows, ranges).mapInArrow(
        _cut_bytes,
        f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_bytes binary",
    )
    return out.withColumnRenamed("id", id_col)
