"""Exact duplicates through content-defined chunk recipes.

A text is normalised, cut into chunks where a rolling hash of its content says so, and described by
its recipe: the ordered fingerprints of its chunks. Texts whose recipe of fingerprints occurs once
have no copy. For the others the chunks, not the documents, are brought together by fingerprint,
compared byte by byte and given verified identifiers (fingerprint and number among the different
chunks with that fingerprint). Texts are equal when their lists of identifiers are equal.

A long text is read where it lies and never moved as a whole: a shuffle carries a recipe, or one
chunk of bounded size, and equal chunks are combined before the shuffle.

Defined cases: null counts as the empty text; repeated rows are equal texts and all of them count
in the group size; rows with a null id count, and stay only in a group without other ids; an empty
table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import bounded_batches, having, settle

ROLLING = 48
MEAN = 4096
LEAST = 1024
MOST = 65536

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def chunk_ends(text: np.ndarray) -> list[int]:
    """Ends of the chunks of one text: where the last ``ROLLING`` bytes hash low, within size limits."""
    n = len(text)
    if n <= LEAST:
        return [n]
    sums = A.prefix(A.byte_values(text))
    cuts = np.flatnonzero(A.grams(sums, ROLLING) < np.uint64((1 << 64) // MEAN)) + ROLLING
    ends, last = [], 0
    while n - last > LEAST:
        at = np.searchsorted(cuts, last + LEAST)
        end = min(int(cuts[at]) if at < len(cuts) else n, last + MOST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def _chunks(text: bytes) -> list[bytes]:
    ends = chunk_ends(np.frombuffer(text, np.uint8))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _fingerprint(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def _recipe(text: bytes) -> bytes:
    """Digest of the ordered fingerprints."""
    return hashlib.blake2b(b"".join(map(_fingerprint, _chunks(text))), digest_size=16).digest()


def _recipes(batches):
    for batch in batches:
        recipe, sha = [], []
        for value in batch.column(1):
            text = _normalised(value.as_py())
            recipe.append(_recipe(text))
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())], ["id", "recipe", "text_sha256"]
        )


def _placed_chunks(batches):
    for batch in batches:
        out: list[tuple] = []
        for value in batch.column(0):
            text = _normalised(value.as_py())
            key = hashlib.sha256(text).hexdigest()
            recipe = _recipe(text)
            out += [(recipe, key, i, _fingerprint(c), c) for i, c in enumerate(_chunks(text))]
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["recipe", "text_sha256", "at", "fingerprint", "chunk"]
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Of equal texts the row with the largest id stays.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    recipes = settle(
        rows.mapInArrow(_recipes, f"id {kind}, recipe binary, text_sha256 string"), "recipes"
    )
    again = settle(
        recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("recipe"), "again"
    )
    suspects = settle(recipes.join(again, "recipe", "left_semi"), "suspects")
    bearers = suspects.groupBy("recipe", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    # Every row of a repeated recipe sends its chunks; equal chunks at one place of one recipe are
    # combined in the task that reads them.
    placed = having(rows, settle(suspects.select("id").distinct(), "copies")).select("text").mapInArrow(
        _placed_chunks, "recipe binary, text_sha256 string, at bigint, fingerprint binary, chunk binary"
    )
    distinct = settle(placed.distinct(), "chunks")
    # Different chunks under one fingerprint get different numbers; there is one in all likelihood.
    numbers = distinct.groupBy("fingerprint").agg(F.sort_array(F.collect_set("chunk")).alias("kinds"))
    identified = distinct.join(numbers, "fingerprint").select(
        "recipe", "text_sha256", "at", "fingerprint", F.array_position("kinds", F.col("chunk")).alias("number")
    )
    lists = identified.groupBy("recipe", "text_sha256").agg(
        F.sort_array(F.collect_set(F.struct("at", "fingerprint", "number"))).alias("identifiers")
    )
    # Equal lists of verified identifiers are one group.
    groups = settle(
        lists.join(bearers, ["recipe", "text_sha256"])
        .groupBy("identifiers")
        .agg(
            F.max("last").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.collect_set(F.struct("recipe", "text_sha256")).alias("members"),
        )
        .select(F.explode("members").alias("m"), "keep_id", "group_size")
        .select(F.col("m.recipe").alias("_recipe"), F.col("m.text_sha256").alias("_sha"), "keep_id", "group_size"),
        "groups",
    )
    match = (F.col("recipe") == F.col("_recipe")) & (F.col("text_sha256") == F.col("_sha"))
    out = recipes.join(groups, match, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
