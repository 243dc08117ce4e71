"""Duplicate passages by relative Lempel-Ziv factoring against earlier documents.

``factor_dedup`` removes words covered by a window of ``window`` words that also starts in a
document with a smaller id. The reference blocks are the run contents of ``repeats``: a block that
equals one of an earlier document is a factor as a whole. All other blocks that share a mark are
indexed window by window with the earliest document that holds the window; each block is factored
greedily against that index, a factor going on while the next window continues in the reference.
Windows of marks too large for a task are looked up by digest on Spark. Factors of at least ``window`` words become duplicate spans, after their words have been compared
with the reference's from the first window of the factor to the last. Every window is looked up, so
windows that cross the end of a factor are not missed.

Defined cases: null text has no words; a null id counts as after all others, and null ids do not
precede each other; rows that share an id do not duplicate each other; repeated rows give repeated
results; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.repeats import Windows, cut_texts, own_ranges, removed_ranges

WINDOW = 13
GRAM = 5


def _word_values(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = A.words(buffer, bounds)
    return A.word_values(buffer, starts, ends), rows


def factor_windows(
    symbols: np.ndarray, bounds: np.ndarray, first: list, _: np.ndarray, width: int
) -> np.ndarray:
    """Starts of windows inside a factor that copies from an earlier document."""
    hit = np.zeros(len(symbols), bool)
    lengths = np.diff(bounds)
    at = A.ragged(bounds[:-1], np.maximum(lengths - width + 1, 0))
    if not len(at):
        return hit
    # Ids by rank; a null id comes last, and equal ids have equal ranks.
    ranks = {value: rank for rank, value in enumerate(sorted({f for f in first if f is not None}))}
    owner = np.array([ranks.get(f, len(ranks)) for f in first], np.int64)[np.searchsorted(bounds, at, "right") - 1]
    window = A.grams(A.prefix(symbols), width)[at]
    # The index: each window's first place in the earliest document that holds it.
    order = np.lexsort((at, owner, window))
    heads = np.concatenate(([True], window[order][1:] != window[order][:-1]))
    source = np.empty(len(at), np.int64)
    source[order] = order[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]
    copied = owner[source] < owner
    # A factor goes on while the next window is copied from the next place of the same reference.
    diagonal = at[source] - at
    begins = copied.copy()
    begins[1:] &= ~(copied[:-1] & (diagonal[1:] == diagonal[:-1]) & (at[1:] == at[:-1] + 1))
    factor = np.cumsum(begins)
    agrees = copied.copy()
    for step in range(width):
        agrees[copied] &= symbols[at[copied] + step] == symbols[at[source][copied] + step]
    broken = np.unique(factor[copied & ~agrees])
    if len(broken):  # two windows with one hash: the factor is taken window by window
        copied &= agrees | ~np.isin(factor, broken)
    hit[at[copied]] = True
    return hit


def _cut_words(batches):
    for batch in batches:
        ids, texts, ranges = batch.column(0), batch.column(1), batch.column(2)
        kept, total, removed, spans = [], [], [], []
        for i in range(batch.num_rows):
            text = (texts[i].as_py() or "").encode()
            words = text.split()
            starts, ends = own_ranges(ranges[i].as_py())
            total.append(len(words))
            removed.append(int((ends - starts).sum()))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
            if len(starts):
                edges = np.concatenate(([0], np.stack((starts, ends), 1).ravel(), [len(words)]))
                words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.string()),
            ],
            ["id", "n_words", "n_removed", "spans", "kept_text"],
        )


def factor_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``id_col, n_words, n_removed, spans (word ranges), kept_text``, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spec = Windows(window, gram, _word_values, "uint64", False)
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    earlier = F.col("least").isNotNull() & (F.col("first").isNull() | (F.col("least") < F.col("first")))
    ranges = removed_ranges(rows, spec, factor_windows, later, ~later, F.col("n") >= 2, earlier)
    kind = dict(rows.dtypes)["id"]
    out = cut_texts(rows, ranges).mapInArrow(
        _cut_words,
        f"id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string",
    )
    return out.withColumnRenamed("id", id_col)
