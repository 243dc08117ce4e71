"""Best-fit packing of documents into sequences by bin completion.

Documents become token ids and an end id. Longer ones are cut into pieces of ``capacity`` ids, of
which the first may be shorter. Pieces are dealt by hash of id, piece, ids and place into shards of about
``shard_pieces``, so that rows without id, or alike in all, are spread like others, and each shard is packed by branch and bound on its lengths:

* pieces that leave no room for the smallest one, such as full pieces of cut documents, are bins of
  their own and take no part in what follows;
* the incumbent is best fit by falling length; it is final if it meets ``lower_bound``;
* otherwise bins are completed one by one. The largest piece left opens a bin; all fillings for the
  rest of it are enumerated lazily, a few promising ones first, then all by rising waste. Those that leave
  room for another piece, or whose pieces fit into the pieces of one tried before, are dominated and left out;
* a branch ends when its waste exceeds what a packing with one sequence less could waste. A better
  packing becomes the incumbent; the search ends at the lower bound, when all branches have ended, or
  after ``nodes`` bins, ``descents`` times the incumbent's bins if that is more. That limit is the only one; with
  it the incumbent stands, so every piece is packed. ``Packing.proven`` says whether fewer are impossible.

A shard wastes less than about one sequence beyond what its pieces force, against thousands that it
fills. Only lengths are shuffled, not ids, and no shard depends on a hot source or a long document.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed each; null
ids are kept; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm import arrays as A
from topicwell.llm.tables import bounded_batches, parts, settle
from topicwell.llm.tokens import default_path, tokens

CAPACITY = 1024
END = 2
SHARD_PIECES = 8192
NODES = 6_000
# Packings that the search can go through at least: bins put on the path, for each bin of the incumbent.
DESCENTS = 4
# Fillings that are tried before the enumeration starts. They decide the order, not what is tried.
HEADS = 10
# Fillings of one bin that a new one is compared with for dominance, and its pieces. Dominated fillings that
# are not recognised cost time and change nothing.
COMPARED, PIECES = 32, 6


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: each length, falling, into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for length in sorted(lengths, reverse=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(length)
        else:
            room, at = capacity, len(bins)
            bins.append([length])
        by_room[room - length].append(at)
        rooms |= 1 << (room - length)
    return bins


def _fits_into(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the pieces of ``small`` can be put into pieces of ``large``."""
    if not small:
        return True
    head, rest = small[0], small[1:]
    return any(
        head <= room and _fits_into(rest, (*large[:i], room - head, *large[i + 1 :])) for i, room in enumerate(large)
    )


class _Left:
    """The lengths not packed yet, with a bit per length at hand, and the same bits mirrored."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity = capacity
        self.count = [0] * (capacity + 1)
        self.mask = 0
        self.mirror = 0
        for length in lengths:
            self.put(length)

    def put(self, length: int) -> None:
        self.count[length] += 1
        self.mask |= 1 << length
        self.mirror |= 1 << (self.capacity - length)

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            self.mask &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))

    def most(self, room: int) -> int:
        """Largest length up to ``room``, 0 if there is none."""
        below = self.mask & ((2 << room) - 1)
        return below.bit_length() - 1 if below else 0

    def exact(self, room: int) -> tuple[int, ...] | None:
        """One or two lengths that fill ``room``, the larger as large as can be."""
        if self.mask >> room & 1:
            return (room,)
        pairs = self.mask & (self.mirror >> (self.capacity - room)) & ((1 << room) - 1)
        while pairs:
            large = pairs.bit_length() - 1
            if 2 * large < room:
                return None
            if 2 * large > room or self.count[large] > 1:
                return large, room - large
            pairs ^= 1 << large
        return None

    def promising(self, room: int) -> list[tuple[int, ...]]:
        """For each of the ``HEADS`` largest pieces that fit one filling, by rising waste and number of pieces.

        The largest that still fits follows, and the last one or two are chosen to fill the room if that can be.
        """
        found = []
        head = self.most(room)
        while head and len(found) < HEADS:
            filling, space = [head], room - head
            self.take(head)
            while space:
                last = self.exact(space)
                if last is None:
                    following = self.most(space)
                    if not following:
                        break
                    last = (following,)
                for length in last:
                    self.take(length)
                filling += last
                space -= sum(last)
            for length in filling:
                self.put(length)
            found.append(tuple(sorted(filling, reverse=True)))
            head = self.most(head - 1)
        return sorted(dict.fromkeys(found), key=lambda f: (room - sum(f), len(f)))

    def fillings(self, room: int, most_waste: int) -> Iterator[tuple[int, ...] | None]:
        """Undominated fillings of ``room`` that waste no more than ``most_waste``: promising ones, then all by rising waste.

        None stands for one that is dominated, so that a search can count it. Pieces taken between two of
        them have to be put back before the next is asked for.
        """
        if self.mask >> room & 1 or not room:
            yield (room,) if room else ()  # fills the room alone and dominates all others
            return
        tried = [f for f in self.promising(room) if room - sum(f) <= most_waste]
        yield from tried
        seen = set(tried)
        for filling in self._sums(room, most_waste):
            waste = room - sum(filling)
            dominated = filling in seen or (waste and self._room_for_more(filling, waste))
            if not dominated and len(filling) <= PIECES:
                dominated = any(len(g) <= len(filling) and _fits_into(filling, g) for g in tried[:COMPARED])
            if dominated:
                yield None
                continue
            tried.append(filling)
            yield filling

    def _room_for_more(self, filling: tuple[int, ...], waste: int) -> bool:
        for length in filling:
            self.take(length)
        more = self.most(waste)
        for length in filling:
            self.put(length)
        return more > 0

    def _sums(self, room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
        """All fillings by falling sum, pieces falling. Every step leads to one: sums that cannot be made are known."""
        lengths = [n for n in range(1, room + 1) if self.mask >> n & 1]
        counts = [min(self.count[n], room // n) for n in lengths]
        whole = (2 << room) - 1
        made = [1]  # bit s of made[i]: the first i lengths make the sum s
        for length, count in zip(lengths, counts):
            sums, step = made[-1], 1
            while count:
                step = min(step, count)
                sums |= (sums << step * length) & whole
                count -= step
                step *= 2
            made.append(sums)

        def exactly(total: int, upto: int) -> Iterator[tuple[int, ...]]:
            if not total:
                yield ()
                return
            for i in reversed(range(min(upto, bisect_right(lengths, total)))):
                length = lengths[i]
                for times in range(min(counts[i], total // length), 0, -1):
                    rest = total - times * length
                    if made[i] >> rest & 1:
                        for tail in exactly(rest, i):
                            yield (length,) * times + tail

        for waste in range(min(most_waste, room) + 1):
            if made[-1] >> (room - waste) & 1:
                yield from exactly(room - waste, len(lengths))

    def choices(self, largest: int, most_waste: int) -> Iterator[tuple[int, ...] | None]:
        """Bins around the largest piece left, None for dominated ones."""
        found = self.fillings(self.capacity - largest, most_waste)
        while True:
            self.take(largest)
            try:
                filling = next(found)
            except StopIteration:
                return
            finally:
                self.put(largest)
            yield None if filling is None else (largest, *filling)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: long pieces by number, and the rest by what their bins can hold."""
    sizes = np.sort(np.asarray(lengths, np.int64))
    sums = np.concatenate(([0], np.cumsum(sizes)))
    least = np.arange(capacity // 2 + 1)
    half = np.searchsorted(sizes, capacity // 2, "right")
    big = np.searchsorted(sizes, capacity - least, "right")
    small = np.searchsorted(sizes, least)
    middle = np.maximum(big, half) - half
    room = middle * capacity - (sums[np.maximum(big, half)] - sums[half])
    rest = np.maximum(0, sums[half] - sums[np.minimum(small, half)] - room)
    return int((len(sizes) - half + -(-rest // capacity)).max(initial=0))


@dataclass(frozen=True)
class Packing:
    """Bins of lengths, and whether the search has shown that fewer are impossible."""

    bins: list[list[int]]
    proven: bool


def search_bins(lengths: list[int], capacity: int, nodes: int = NODES, descents: int = DESCENTS) -> Packing:
    """Bins of lengths, as few as the search finds."""
    # The smallest piece stays, so one round finds them all; it is alone only if every piece is.
    least = min(lengths, default=0)
    alone = [[length] for length in lengths if length + least > capacity]
    if alone:
        rest = search_bins([length for length in lengths if length + least <= capacity], capacity, nodes, descents)
        return Packing(alone + rest.bins, rest.proven)
    best = best_fit(lengths, capacity)
    nodes = max(nodes, descents * len(best)) if nodes else 0
    total = sum(lengths)
    bound = lower_bound(lengths, capacity)
    left = _Left(lengths, capacity)
    path: list[list[int]] = []
    open_bins: list[Iterator[tuple[int, ...]]] = []
    wastes = [0]
    while len(best) > bound and nodes > 0:
        spare = (len(best) - 1) * capacity - total
        if not left.mask:
            best = [list(b) for b in path]
            spare = (len(best) - 1) * capacity - total
        elif len(open_bins) == len(path) and wastes[-1] <= spare:
            open_bins.append(left.choices(left.mask.bit_length() - 1, spare - wastes[-1]))
        # The next choice at the deepest open bin; done bins above it are undone on the way.
        while open_bins:
            if len(path) == len(open_bins):
                for length in path.pop():
                    left.put(length)
                wastes.pop()
            filling = next(open_bins[-1], ())
            if filling == ():
                open_bins.pop()
                continue
            waste = None if filling is None else wastes[-1] + capacity - sum(filling)
            if waste is None or waste > spare:
                # What is passed over counts too, so the limit bounds the time.
                nodes -= 1
                if nodes <= 0:
                    break
                continue
            for length in filling:
                left.take(length)
            path.append(list(filling))
            wastes.append(waste)
            nodes -= 1
            break
        if not open_bins:
            return Packing(best, True)
    return Packing(best, len(best) <= bound)


def complete_bins(lengths: list[int], capacity: int, nodes: int = NODES, descents: int = DESCENTS) -> list[list[int]]:
    return search_bins(lengths, capacity, nodes, descents).bins


def pack_lengths(
    lengths: np.ndarray, capacity: int, nodes: int = NODES, descents: int = DESCENTS
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    bins = complete_bins(lengths.tolist(), capacity, nodes, descents)
    flat = np.fromiter((x for b in bins for x in b), np.int64, len(lengths))
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    number = np.repeat(np.arange(len(bins)), sizes)
    ends = np.cumsum(flat)
    before = ends - flat
    offset = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes) if len(flat) else before
    # Equal lengths are interchangeable: places and pieces are matched in order of length.
    place, piece = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    out_bin[piece], out_offset[piece] = number[place], offset[place]
    return out_bin, out_offset


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    def cut(batches):
        encoder = tokens(path)
        for batch in batches:
            column = batch.column(1)
            for row, _, bounds in A.blocks(column):
                texts = [t or "" for t in column.slice(row, len(bounds) - 1).to_pylist()]
                at, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    n = len(ids)
                    head = n % capacity or capacity
                    cuts = [0, *range(head, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at.append(row + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def _packed(capacity: int, nodes: int, descents: int):
    def packed(table: pa.Table) -> pa.Table:
        shard = table.column("_shard")[0].as_py()
        number, offset = pack_lengths(table.column("length").to_numpy(), capacity, nodes, descents)
        out = table.drop_columns(["_shard"])
        out = out.append_column("sequence_id", pa.array(number + (shard << 32), pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    return packed


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    shard_pieces: int = SHARD_PIECES,
    nodes: int = NODES,
    descents: int = DESCENTS,
    with_ids: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset``, and ``ids`` if asked for.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    columns = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    columns += ", ids array<int>" if with_ids else ""
    pieces = settle(rows.mapInArrow(_cut(tokenizer or default_path(), capacity, end, with_ids), columns), "pieces")
    shards = F.lit(parts(pieces, shard_pieces))
    # The place in the written pieces tells rows alike in all else apart.
    place = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.col("_metadata.row_index")]
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", *place), shards))
    out = dealt.groupBy("_shard").applyInArrow(_packed(capacity, nodes, descents), f"{columns}, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
