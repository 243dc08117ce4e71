"""Ranked lexical search with Block-Max MaxScore.

The documents are described once for the terms of the queries: their length in terms and how often each
term occurs. From the whole corpus come the number of documents, of terms, and of each term the documents
that hold it and its largest share of a score, the term's global bound.

The index is a table of segments. A segment holds some thousand documents, in the order of their ids, and
per term a posting list in blocks. A block is its first and last place, the largest share in it, and its
places and frequencies, packed as byte-aligned gaps. A segment never leaves the task that reads it.

A task keeps a heap per query and searches one segment after the other. The lists of a query are ordered by
global bound. Those whose bounds together stay below the lowest score of the heap are not essential: what
is found in them alone cannot enter the heap. The essential lists give the candidates. Of the other lists
only the block maxima are looked at first; a candidate whose score with these stays below the heap is
rejected before a block is unpacked, and again after each list. The heaps of all tasks are merged.

Scores are whole numbers, so nothing depends on the order in which they are summed up.

Defined cases: a null or empty text, or one without a term, is in no result and not counted; a query
without terms has no result; every row is a document of its own, and every row of the queries a query of its
own, also if rows share an id; among equal scores a null id comes last; an empty table on either side gives
an empty result; other columns are ignored. Document ids are numbers or texts. A text may be of any length:
what is kept of it is at most one posting per query term. Terms are told apart by two 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import numbered, settle

TOP = 20
# Documents of a segment (below 65,536, so that a place has two bytes) and postings of a block.
SEGMENT = 8192
BLOCK = 128
# Queries that are searched for in one pass over the documents.
QUERIES_AT_ONCE = 1024

# The characters that are no part of a term.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_TERM = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])
# A second hash of a term, with other byte values.
_SECOND = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCALE = 1_000_000_000


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, A-Z lower-cased."""
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a query term adds to the score, before its weight."""
    return SCALE * tf // (1000 * tf + 12 * m)


def spans(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms of some rows, and the first term of each row."""
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = _IN_TERM[buffer]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    # A row's first and last byte begin and end a term whatever lies beside them.
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    begins[first] = inside[first + 1]
    ends[last] = inside[last + 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


class Vocabulary:
    """The different terms of some queries, found in texts by two hashes."""

    def __init__(self, terms: list[str]) -> None:
        data = [t.encode() for t in terms]
        buffer = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(x) for x in data])
        one, two = self._hashes(buffer, np.concatenate(([0], ends[:-1])).astype(np.int64), ends)
        order = np.argsort(one)
        self.one, self.two, self.number = one[order], two[order], order

    @staticmethod
    def _hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return A.word_values(lowered, starts, ends), A.slices(A.prefix(_SECOND[lowered]), starts, ends)

    def find(self, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        one, two = self._hashes(lowered, starts, ends)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), self.number[at], -1)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _describe(vocabulary: Vocabulary):
    """Length and query terms of every document that has a term."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buffer, bounds in A.blocks(batch.column(1)):
                starts, ends, of_row = spans(buffer, bounds)
                length = np.diff(of_row)
                number = vocabulary.find(_LOWER[buffer], starts, ends)
                hit = number >= 0
                size = len(vocabulary.number)
                code = np.repeat(np.arange(len(length)), length)[hit] * size + number[hit]
                code, tf = np.unique(code, return_counts=True)
                held = np.bincount(code // size, minlength=len(length))
                rows = np.flatnonzero(length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows + row)),
                        pa.array(length[rows].astype(np.int64)),
                        _lists(code % size, held[rows], pa.int32()),
                        _lists(tf, held[rows], pa.int32()),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    return described


def pack(places: np.ndarray, tf: np.ndarray) -> bytes:
    """Rising places and their frequencies as gaps of one or two bytes and counts of one, two or four."""
    gaps = np.diff(places, prepend=places[0])
    wide = int(gaps.max() > 255)
    size = 1 if tf.max() < 256 else 2 if tf.max() < 65536 else 4
    return bytes([wide, size]) + gaps.astype("<u2" if wide else "<u1").tobytes() + tf.astype(f"<u{size}").tobytes()


def unpack(first: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, size = data[0], data[1]
    n = (len(data) - 2) // (wide + 1 + size)
    gaps = np.frombuffer(data, "<u2" if wide else "<u1", n, 2)
    tf = np.frombuffer(data, f"<u{size}", n, 2 + n * (wide + 1))
    return first + np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)


SEGMENTS = (
    "ids array<{}>, m array<bigint>, terms array<int>, blocks array<int>, "
    "first array<int>, last array<int>, best array<bigint>, postings array<binary>"
)


def _order(ids: list) -> list[int]:
    """Places in the order of the ids, nulls last."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))


def segment(docs: pa.Table) -> pa.RecordBatch:
    """One segment of the documents ``id, m, terms, tfs``."""
    docs = docs.take(pa.array(_order(docs.column("id").to_pylist()), pa.int64())).combine_chunks()
    m = docs.column("m").to_numpy()
    terms = docs.column("terms").combine_chunks()
    held = np.diff(terms.offsets.to_numpy())
    place = np.repeat(np.arange(len(m)), held)
    number = terms.flatten().to_numpy()
    tf = docs.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    order = np.lexsort((place, number))
    place, number, tf = place[order], number[order], tf[order]
    shares = share(tf, m[place])
    own, begins = np.unique(number, return_index=True)
    stops = np.append(begins[1:], len(number))
    cuts = [np.arange(a, b, BLOCK) for a, b in zip(begins, stops)]
    starts = np.concatenate([*cuts, np.empty(0, np.int64)]).astype(np.int64)
    ends = np.concatenate([*[np.append(c[1:], b) for c, b in zip(cuts, stops)], np.empty(0, np.int64)]).astype(np.int64)
    best = np.maximum.reduceat(shares, starts) if len(starts) else shares
    columns = [
        docs.column("id").combine_chunks(),
        pa.array(m, pa.int64()),
        pa.array(own, pa.int32()),
        pa.array([len(c) for c in cuts], pa.int32()),
        pa.array(place[starts], pa.int32()),
        pa.array(place[ends - 1], pa.int32()),
        pa.array(best, pa.int64()),
        pa.array([pack(place[a:b], tf[a:b]) for a, b in zip(starts, ends)], pa.binary()),
    ]
    whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays(whole, ["ids", "m", "terms", "blocks", "first", "last", "best", "postings"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SEGMENT):
            part = batch.slice(at, SEGMENT)
            if held + part.num_rows > SEGMENT:
                yield segment(pa.Table.from_batches(waiting))
                waiting, held = [], 0
            waiting.append(part)
            held += part.num_rows
    if waiting:
        yield segment(pa.Table.from_batches(waiting))


@dataclass
class Segment:
    """A segment as a task reads it. Blocks are unpacked when they are asked for, once."""

    ids: list
    m: np.ndarray
    place_of: dict[int, int]
    edges: np.ndarray
    first: np.ndarray
    last: np.ndarray
    best: np.ndarray
    packed: list[bytes]
    unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def read(cls, row: dict) -> Segment:
        edges = np.concatenate(([0], np.cumsum(row["blocks"]))).astype(np.int64)
        numbers = {int(t): i for i, t in enumerate(row["terms"])}
        arrays = [np.array(row[c], np.int64) for c in ("first", "last", "best")]
        return cls(row["ids"], np.array(row["m"], np.int64), numbers, edges, *arrays, row["postings"])

    def blocks(self, term: int) -> slice:
        at = self.place_of[term]
        return slice(int(self.edges[at]), int(self.edges[at + 1]))

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and shares of one block."""
        if number not in self.unpacked:
            places, tf = unpack(int(self.first[number]), self.packed[number])
            self.unpacked[number] = places, share(tf, self.m[places])
        return self.unpacked[number]

    def postings(self, numbers) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(i)) for i in numbers]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


@dataclass
class Query:
    """Terms of one query with their weights, repeats included, and the heap of its best documents."""

    number: int
    terms: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    heap: list[tuple] = field(default_factory=list)

    def lowest(self, top: int) -> int:
        """The least score that can still enter the heap."""
        return -self.heap[-1][0] if len(self.heap) >= top else 1


def search_segment(query: Query, segment: Segment, top: int) -> None:
    """Take the documents of a segment into the heap of a query that belong there."""
    held = [i for i, t in enumerate(query.terms.tolist()) if t in segment.place_of]
    if not held:
        return
    held = np.array(held)[np.argsort(query.bounds[held], kind="stable")]
    lowest = query.lowest(top)
    # Lists in front whose bounds together stay below the heap are not essential.
    essential = int(np.searchsorted(np.cumsum(query.bounds[held]), lowest))
    if essential == len(held):
        return
    score = np.zeros(len(segment.m), np.int64)
    for i in held[essential:]:
        blocks = segment.blocks(int(query.terms[i]))
        places, shares = segment.postings(range(blocks.start, blocks.stop))
        score[places] += query.weights[i] * shares
    found = np.flatnonzero(score)
    rest = held[:essential][::-1]
    # Of every other list the block in which a candidate would be, and what that can add at most.
    block_of = np.empty((len(rest), len(found)), np.int64)
    at_most = np.empty((len(rest), len(found)), np.int64)
    for row, i in enumerate(rest):
        blocks = segment.blocks(int(query.terms[i]))
        at = blocks.start + np.searchsorted(segment.last[blocks], found)
        inside = at < blocks.stop
        at = np.minimum(at, blocks.stop - 1)
        inside &= segment.first[at] <= found
        block_of[row] = np.where(inside, at, -1)
        at_most[row] = np.where(inside, query.weights[i] * segment.best[at], 0)
    reach = score[found] + at_most.sum(0)
    for row, i in enumerate(rest):
        alive = reach >= lowest
        found, reach, block_of, at_most = found[alive], reach[alive], block_of[:, alive], at_most[:, alive]
        wanted = np.unique(block_of[row])
        wanted = wanted[wanted >= 0]
        reach -= at_most[row]
        if not len(wanted):
            continue
        places, shares = segment.postings(wanted)
        at = np.minimum(np.searchsorted(places, found), len(places) - 1)
        reach += np.where(places[at] == found, query.weights[i] * shares[at], 0)
    alive = reach >= lowest
    found, reach = found[alive], reach[alive]
    # Places follow the ids, so of equal scores the first ones have the least ids.
    best = np.lexsort((found, -reach))[:top]
    entries = [(-int(reach[b]), segment.ids[found[b]] is None, segment.ids[found[b]]) for b in best]
    query.heap = sorted(query.heap + entries, key=_rank)[:top]


def _rank(entry: tuple) -> tuple:
    score, missing, key = entry
    return score, missing, 0 if missing else key


def _searched(queries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], kind: pa.DataType, top: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Query(*q) for q in queries]
        for batch in batches:
            for row in batch.to_pylist():
                read = Segment.read(row)
                for query in own:
                    search_segment(query, read, top)
        found = [(q.number, key, -score) for q in own for score, _, key in q.heap]
        columns = list(zip(*found)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())],
            ["query", "id", "score"],
        )

    return searched


@dataclass(frozen=True)
class Index:
    """Segments over all documents for the terms of some queries, with the figures of the whole corpus."""

    segments: DataFrame
    terms: list[str]
    weights: np.ndarray
    bounds: np.ndarray


def build_index(rows: DataFrame, terms: list[str]) -> Index | None:
    """The index of the documents ``id, text`` for different ``terms``; None if no document has a term at all."""
    kind = dict(rows.dtypes)["id"]
    docs = settle(
        rows.mapInArrow(_describe(Vocabulary(terms)), f"id {kind}, n bigint, terms array<int>, tfs array<int>"),
        "described",
    )
    documents, length = docs.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    m = (F.lit(75).cast("bigint") + div(F.col("n") * (25 * documents), F.lit(length))).alias("m")
    sized = docs.select("id", m, "terms", "tfs")
    posting = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    tf = F.col("p.tfs").cast("bigint")
    held = sized.select("m", posting).select(
        F.col("p.terms").alias("term"), div(tf * SCALE, tf * 1000 + F.col("m") * 12).alias("share")
    )
    # One row per term of the queries.
    found = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("share").alias("best")).collect()
    weights, best = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for r in found:
        weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
        best[r.term] = r.best
    segments = settle(sized.mapInArrow(_segments, SEGMENTS.format(kind)), "segments")
    return Index(segments, terms, weights, weights * best)


def search(index: Index, queries: list[tuple[int, list[str]]], top: int = TOP) -> DataFrame:
    """``query, id, score``: the heaps of all tasks. ``queries`` are numbers and terms with repeats."""
    number = {t: i for i, t in enumerate(index.terms)}
    asked = []
    for query, terms in queries:
        own, times = np.unique(np.array([number[t] for t in terms], np.int64), return_counts=True)
        use = index.weights[own] > 0
        own, times = own[use], times[use]
        asked.append((query, own, index.weights[own] * times, index.bounds[own] * times))
    ids = index.segments.schema["ids"].dataType.elementType
    kind = pa.string() if ids.typeName() == "string" else pa.int64()
    return index.segments.mapInArrow(
        _searched([q for q in asked if len(q[1])], kind, top),
        f"query bigint, id {'string' if ids.typeName() == 'string' else 'bigint'}, score bigint",
    )


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    top: int = TOP,
    at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """``query_col, rank, id_col, score``: the ``top`` documents of each query with a score above 0.

    All queries are answered over all documents; ``at_once`` of them share a pass, so the driver and a task
    hold the terms of so many queries and no more.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_col).alias("name"), F.col(query_text_col).alias("text"))
    asked = settle(numbered(asked, [F.col("name"), F.col("text")], "query"), "queries")
    blocks = -(-asked.count() // at_once)
    found = [rows.sparkSession.createDataFrame([], f"query bigint, id {dict(rows.dtypes)['id']}, score bigint")]
    for block in range(blocks):
        own = asked.where(F.col("query").between(block * at_once, (block + 1) * at_once - 1)).collect()
        terms = [(r["query"], terms_of(r["text"])) for r in own]
        vocabulary = sorted({t for _, x in terms for t in x})
        index = build_index(rows, vocabulary) if vocabulary else None
        if index is not None:
            found.append(settle(search(index, terms, top), "heaps"))
    merged = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = ranked.join(asked.select("query", "name"), "query")
    return named.select(F.col("name").alias(query_col), "rank", F.col("id").alias(id_col), "score")
