"""Quality scores by a generalised additive model with pairwise interactions.

A text is described by numbers that need no model: lengths, shares of kinds of characters, how words
end and repeat. Each feature is cut into bins at quantiles of the learning rows. Boosting goes round
the features in turn, and each visit fits a shallow tree on one feature's bins to the gradient and
adds it, at a small rate, to the feature's lookup table; then the pairs of features that explain
most of what is left get tables of their own in the same way. A score is the logistic of the sum of
the table entries at the text's bins.

The model is fitted on at most ``ROWS`` labelled rows, chosen by hash of their id, which bounds what
comes to the driver; every text is scored whole, where it lies.

Defined cases: null text is empty, and empty texts are scored like others; labels other than 0 and
1, or null, are not learned from; several labels of one document are several rows; without any
label every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import bounded_batches, having, settle

ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1

_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (32, 9),
    "line": (10, 13),
    "stop": (46, 33, 63),
    "shout": (33,),
    "comma": (44, 59, 58),
    "mark": (*range(35, 39), 42, 43, *range(60, 63), 64, 91, 92, 93, 94, 95, 96, *range(123, 127)),
    "bar": (124,),
    "other": range(128, 256),
}
_TABLE = np.zeros((256, len(_KINDS)))
for _i, _points in enumerate(_KINDS.values()):
    _TABLE[list(_points), _i] = 1
_ENDS = np.zeros(256, np.int64)  # how a word ends: letter or digit 0, stop or comma 1, anything else 2
_ENDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_ENDS[[44, 46, 58, 59]] = 1

FEATURES = (
    "log_bytes", "log_words", "word_bytes", *[f"{k}_share" for k in _KINDS], "entropy", "distinct_words",
    "top_word", "same_as_before", "ends_plain", "ends_odd", "short_words", "capital_words", "long_words",
    "distinct_pairs", "words_per_line", "words_per_stop",
)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values and the most frequent one's count in every row."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((values >> np.uint64(24)) | (row.astype(np.uint64) << np.uint64(40)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=rows).astype(float), most


def features(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(rows), sizes)
    histogram = np.bincount(row * 256 + buffer, minlength=rows * 256).reshape(rows, 256)
    n = np.maximum(sizes, 1)
    kinds = histogram @ _TABLE
    share = histogram / n[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    starts, ends, cut = A.words(buffer, bounds)
    words = np.diff(cut)
    w = np.maximum(words, 1)
    values = A.word_values(buffer, starts, ends)
    owner = np.repeat(np.arange(rows), words)
    lengths = ends - starts
    distinct, top = _distinct(values, owner, rows)
    same = np.zeros(len(values))
    pairs = np.empty(0, np.uint64)
    if len(values):
        same[1:] = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
        inner = owner[1:] == owner[:-1]
        pairs = A.mix(values[1:] * np.uint64(3) + values[:-1])[inner]
    distinct_pairs, _ = _distinct(pairs, owner[1:][inner] if len(values) else owner, rows)
    ending = _ENDS[buffer[ends - 1]] if len(ends) else np.empty(0, np.int64)
    first = buffer[starts] if len(starts) else np.empty(0, np.uint8)
    per_word = [
        same, ending == 0, ending == 2, lengths <= 3, (first >= 65) & (first <= 90), lengths >= 16,
    ]
    names = list(_KINDS)
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(words), _row_sums(lengths, cut) / w, kinds / n[:, None], entropy, distinct / w,
            top / w, *[_row_sums(x, cut) / w for x in per_word], distinct_pairs / np.maximum(words - 1, 1),
            words / (kinds[:, names.index("line")] + 1), words / (kinds[:, names.index("stop")] + 1),
        ]
    )


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best cuts one after the other."""
    total_g, total_w = np.cumsum(gradient), np.cumsum(weight)

    def part(a: int, b: int) -> tuple[float, float]:
        return (
            total_g[b - 1] - (total_g[a - 1] if a else 0.0),
            total_w[b - 1] - (total_w[a - 1] if a else 0.0) + 1.0,
        )

    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for at, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            g, w = part(a, b)
            left_g = total_g[a : b - 1] - (total_g[a - 1] if a else 0.0)
            left_w = total_w[a : b - 1] - (total_w[a - 1] if a else 0.0) + 1.0
            gain = left_g**2 / left_w + (g - left_g) ** 2 / (w - left_w + 1.0) - g * g / w
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (gain[cut], at, a + cut + 1)
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(gradient))
    for a, b in spans:
        g, w = part(a, b)
        out[a:b] = g / w
    return out


def _shallow_grid(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree on two features: one cut of the first, and one of the second on either side."""
    best_gain, best = -1.0, np.zeros_like(gradient)
    for g, w, turned in ((gradient, weight, False), (gradient.T, weight.T, True)):
        for cut in range(1, len(g)):
            out, gain = np.empty_like(g), 0.0
            for side in (slice(0, cut), slice(cut, len(g))):
                step = _shallow_tree(g[side].sum(0), w[side].sum(0), 2)
                out[side] = step
                gain += float((step * g[side].sum(0)).sum())
            if gain > best_gain:
                best_gain, best = gain, out.T if turned else out
    return best, best_gain


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AdditiveModel:
    """Lookup tables by feature, and by pair of features on coarse bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return _logistic(total)


def _quantiles(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of shallow trees, first by feature and then by the best pairs."""
    model = AdditiveModel()
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), model.base)
    model.edges = [_quantiles(c, BINS) for c in x.T]
    model.coarse = [_quantiles(c, COARSE) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    wide = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(total)
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, w = slopes()
            step = RATE * _shallow_tree(
                np.bincount(fine[i], g, len(table)), np.bincount(fine[i], w, len(table)), 4
            )
            table += step
            total += step[fine[i]]

    def grid(a: int, b: int, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        at = wide[a] * shape[1] + wide[b]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, w))

    g, w = slopes()
    ranked = sorted(
        ((_shallow_grid(*grid(a, b, g, w))[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True
    )
    chosen = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for a, b in chosen]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            step = RATE * _shallow_grid(*grid(a, b, *slopes()))[0]
            table += step
            total += step[wide[a], wide[b]]
    return model


def _features(batches):
    for batch in batches:
        found = [features(buffer, bounds) for _, buffer, bounds in A.blocks(batch.column(1))]
        x = np.concatenate(found) if found else np.empty((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"]
        )


def _scores(model: AdditiveModel):
    def run(batches):
        for batch in batches:
            found = [model.score(features(buffer, bounds)) for _, buffer, bounds in A.blocks(batch.column(1))]
            score = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["id", "held_out", "score"])

    return run


def learn_quality(rows: DataFrame, labels: DataFrame, limit: int = ROWS) -> AdditiveModel:
    """Fit on at most ``limit`` labelled documents, those with the least hash of their id.

    The bound holds for the rows of ``labels`` (``id``, ``label``) and again after they are joined to the documents, as
    an id may occur often.
    """
    usable = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    chosen = settle(usable.orderBy(F.xxhash64("id"), "id", "label").limit(limit), "labels")
    x = having(rows.select("id", "text"), chosen.select("id").distinct()).mapInArrow(
        _features, f"id {dict(rows.dtypes)['id']}, x array<double>"
    )
    learned = x.join(chosen, "id").orderBy(F.xxhash64("id"), "id", "label", "x").limit(limit)
    table = learned.orderBy("id", "label", "x").select("x", "label").toArrow()
    data = np.array(table.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return fit_additive(data, table.column("label").to_numpy().astype(float))


def score_quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``id_col, held_out, score, predicted``, one row per row of ``docs``.

    ``held_out`` is over ``id_col`` and read from both tables: labels for which it is true or null
    are not learned from, and null is reported as false.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    learned = labels.where(~held_out).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    model = learn_quality(rows, learned)
    kind = dict(rows.dtypes)["id"]
    out = rows.select("id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(
        _scores(model), f"id {kind}, held_out boolean, score double"
    )
    return out.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
