"""What the pair operators share: links found in cells, summed to classes and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm.tables import components, settle

LINKS = "class binary, links bigint, root binary"


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions reaches over the given pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_batch(classes: pa.Array, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """For every position with a pair: its class, the rows it is linked to, and its local root."""
    n = len(classes)
    links = np.bincount(left, sizes[right], n) + np.bincount(right, sizes[left], n)
    used = np.flatnonzero(links)
    root = roots(n, left, right)
    take = pa.array(used)
    return pa.RecordBatch.from_arrays(
        [classes.take(take), pa.array(links[used].astype(np.int64)), classes.take(pa.array(root[used]))],
        ["class", "links", "root"],
    )


def empty_links() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["class", "links", "root"]
    )


def summed(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``class, size, first, links, component``: ``classes`` with its links and least reachable id.

    ``classes`` has ``class``, ``size`` and ``first`` (least id); ``found`` is one ``LINKS`` row per
    class and cell. A class's rows link with each other too.
    """
    found = settle(found, "links")
    total = found.groupBy("class").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    label = label.toDF("class", "label")
    known = classes.join(total, "class", "left").join(label, "class", "left").select(
        "class", "size", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "class").alias("label")
    )
    known = settle(known, "linked")
    least = known.groupBy("label").agg(F.min("first").alias("component"))
    return known.join(least, "label").select(
        "class", "size", "first", (F.col("links") + F.col("size") - 1).alias("links"), "component"
    )
