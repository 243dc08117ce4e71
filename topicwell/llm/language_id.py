"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier, fitted on counts of hashed
character trigrams over all learning rows, gives the log odds of the bit; its scale is fitted on a
bounded sample. A text gets the language whose codeword has the least logistic loss against the
bits' margins, weighted by how often a bit is right, and is flagged as ambiguous when the next
codeword is nearly as close. Up to five languages take the exhaustive code, more a seeded random
code, the best of several by smallest distance.

The counts are one table of languages by buckets, summed per task before the shuffle; it is bounded
by the number of languages, and so is the model. Texts are read whole and never leave their task.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and is not ambiguous;
rows without a language are not learned from; without any learned language all texts are ``und``;
with one, all others get it; repeated rows count as often as they occur; an empty table gives an
empty result; columns beside those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import bounded_batches

UND = "und"
BITS = 14
BUCKETS = 1 << BITS
# Rows on which the scale of the margins is fitted, about.
SAMPLE = 4000
# Most languages for which a model is fitted.
LANGUAGES = 2000
AMBIGUOUS = 0.6

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _folded(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with a blank for everything else; rows are apart by three blanks."""
    sizes = np.diff(bounds)
    out = np.full(len(buffer) + 3 * len(sizes) + 3, 32, np.uint8)
    at = np.arange(len(buffer)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)
    folded = _FOLD[buffer]
    # U+00C0 to U+00DE in UTF-8: the capital letters of the Latin-1 block.
    capital = np.zeros(len(buffer), bool)
    capital[1:] = (buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E)
    folded[capital] += 0x20
    out[at] = folded
    return out, bounds + 3 * np.arange(len(bounds))


def trigrams(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that have a letter, and the range of each row."""
    text, rows = _folded(buffer, bounds)
    code = text[:-2].astype(np.uint32) | text[1:-1].astype(np.uint32) << 8 | text[2:].astype(np.uint32) << 16
    whole = np.flatnonzero(code != 0x202020)
    bucket = (code[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return bucket, np.searchsorted(whole, rows)


def has_letter(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    counts = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buffer])))
    found = counts[bounds[1:]] > counts[bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in buffer[bounds[i] : bounds[i + 1]].tobytes().decode())
    return found


def code_words(languages: int, seed: int = 5) -> np.ndarray:
    """Rows of -1 and 1; no two rows and, for the exhaustive code, no two columns are alike."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = range(1, 1 << (languages - 1))
        return np.array([[1 if c >> i & 1 else -1 for c in columns] for i in range(languages)], float)
    rng = np.random.default_rng(seed)
    width, best, distance = int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(20):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = code.shape[1] - (code @ code.T)
        np.fill_diagonal(apart, np.inf)
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets: log odds of the bit for each trigram
    scale: np.ndarray  # bits: from mean log odds to a margin
    shift: np.ndarray
    trust: np.ndarray  # bits: weight of the bit's loss

    def raw(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean log odds per row and bit."""
        bucket, rows = trigrams(buffer, bounds)
        size = np.diff(rows)
        out = np.zeros((len(size), len(self.scale)))
        filled = np.flatnonzero(size)
        if len(filled):
            for bit, weights in enumerate(self.weights):
                sums = np.add.reduceat(weights[bucket], rows[filled], dtype=np.float64)
                out[filled, bit] = sums / size[filled]
        return out

    def decode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability-like score and ambiguity of every row."""
        margins = raw * self.scale + self.shift
        against = np.logaddexp(0, -margins) * self.trust
        for_it = np.logaddexp(0, margins) * self.trust
        loss = against @ (self.code > 0).T + for_it @ (self.code < 0).T
        near = np.exp(-(loss - loss.min(1, keepdims=True)))
        share = near / near.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share[np.arange(len(share)), best]
        return best, score, score < AMBIGUOUS


def _counts(batches):
    for batch in batches:
        languages = batch.column(0).to_pylist()
        totals: dict[str, np.ndarray] = {}
        for row, buffer, bounds in A.blocks(batch.column(1)):
            bucket, rows = trigrams(buffer, bounds)
            names = np.array(languages[row : row + len(bounds) - 1], object)
            for language in set(names):
                own = np.flatnonzero(names == language)
                take = A.ragged(rows[own], rows[own + 1] - rows[own])
                counts = np.bincount(bucket[take], minlength=BUCKETS)
                totals[language] = totals.get(language, 0) + counts
        for language, counts in totals.items():
            filled = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(filled), pa.string()), pa.array(filled.astype(np.int32)), pa.array(counts[filled].astype(np.int64))],
                ["lang", "bucket", "n"],
            )


def _raw_margins(model: LanguageModel):
    def run(batches):
        for batch in batches:
            found = [model.raw(buffer, bounds) for _, buffer, bounds in A.blocks(batch.column(1))]
            raw = np.concatenate(found) if found else np.empty((0, len(model.scale)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(raw), pa.list_(pa.float64()))], ["lang", "raw"])

    return run


def _fit_scale(raw: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of a bit on its mean log odds, and the share of rows it gets right."""
    spread = raw.std() or 1.0
    x, scale, shift = raw / spread, 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        slack = p * (1 - p)
        # A small ridge keeps the scale finite where the bit is never wrong.
        gradient = np.array([((p - target) * x).mean() + 1e-3 * scale, (p - target).mean() + 1e-3 * shift])
        cross = (slack * x).mean()
        hessian = np.array([[(slack * x * x).mean() + 1e-3, cross], [cross, slack.mean() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        scale, shift = scale - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    right = (((scale * x + shift) > 0) == (target > 0)).mean()
    return scale / spread, shift, right


def learn_languages(rows: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on ``text, lang``. Counts are over all rows; scales on about ``sample`` of them, by hash of the text."""
    rows = rows.where(F.col("lang").isNotNull())
    counted = rows.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n bigint")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.limit(LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = {language: i for i, language in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    at = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    code = code_words(len(languages))
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    # Languages of one side weigh alike, so that a common one does not speak for the side.
    on, off = code.T > 0, code.T < 0
    weights = np.log(on @ share / np.maximum(on.sum(1, keepdims=True), 1) + 1e-12) - np.log(
        off @ share / np.maximum(off.sum(1, keepdims=True), 1) + 1e-12
    )
    bits = code.shape[1]
    model = LanguageModel(
        tuple(languages), code, weights.astype(np.float32), np.ones(bits), np.zeros(bits), np.ones(bits)
    )
    if len(languages) < 2:
        return model
    total = rows.count()
    of = max(1, total // sample)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0).select("lang", "text").limit(2 * sample)
    seen = chosen.mapInArrow(_raw_margins(model), "lang string, raw array<double>").toArrow()
    if not seen.num_rows:
        return model
    raw = np.array(seen.column("raw").to_pylist())
    target = (code[[place[x] for x in seen.column("lang").to_pylist()]] > 0).astype(float)
    fitted = np.array([_fit_scale(raw[:, b], target[:, b]) for b in range(bits)])
    trust = np.maximum(fitted[:, 2] - 0.5, 0.01)
    return LanguageModel(
        tuple(languages), code, model.weights, fitted[:, 0], fitted[:, 1], trust * bits / trust.sum()
    )


def _predicted(model: LanguageModel):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = np.full(n, UND, object), np.zeros(n), np.zeros(n, bool)
            for row, buffer, bounds in A.blocks(batch.column(1)):
                known = has_letter(buffer, bounds)
                if not model.languages or not known.any():
                    continue
                best, share, near = model.decode(model.raw(buffer, bounds))
                at = row + np.flatnonzero(known)
                lang[at] = np.array(model.languages, object)[best[known]]
                score[at], unsure[at] = share[known], near[known]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)],
                ["id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score, ambiguous``, one row per row of ``docs``.

    Learns from the rows for which ``held_out`` is false; a null there is not learned from and
    reported as false.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out")
    )
    model = learn_languages(rows.where(~F.col("held_out")).select("text", "lang"))
    kind = dict(rows.dtypes)["id"]
    out = rows.select("id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(
        _predicted(model), f"id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
    return out.withColumnRenamed("id", id_col)
