"""Byte-level BPE over whole Arrow columns, with the ids of a ``tokenizers`` file.

A text is split where the file's pattern splits it, on arrays of code points, and each different
piece is encoded once: most pieces of a corpus have been seen before. Texts with code points from
``PLAIN`` on, or that may hold a special token, are given to the ``tokenizers`` library as they are.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from topicwell.llm import arrays as A

PLAIN = 0x180
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOTS = 1 << 21
POOL = 1 << 22

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    kinds = np.full(PLAIN, OTHER, np.uint8)
    for point in range(PLAIN):
        if point in (*range(9, 14), 32, 0x85, 0xA0):
            kinds[point] = SPACE
        else:
            category = unicodedata.category(chr(point))[0]
            kinds[point] = {"L": LETTER, "N": NUMBER}.get(category, OTHER)
    return kinds


_KINDS = _kinds()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin, for rows of code points below ``PLAIN``."""
    n = len(points)
    begin = np.zeros(n + 1, bool)
    if not n:
        return begin[:0]
    row_start = np.zeros(n + 1, bool)
    row_start[bounds] = True
    kind = _KINDS[points]
    run = row_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    runs = np.append(np.flatnonzero(run), n)
    starts, ends = runs[:-1], runs[1:]
    begin[starts] = True
    # White space before something else gives up its last character; a blank joins what follows.
    space = (kind[starts] == SPACE) & ~row_start[ends]
    last = ends[space] - 1
    begin[last] = True
    begin[ends[space]] = points[last] != 32
    # An apostrophe that begins a piece takes one or two letters of a contraction.
    mark = starts[(ends - starts == 1) & (points[starts] == 39) & ~row_start[ends]]
    mark = mark[begin[mark] & (mark + 1 < n)]
    padded = np.append(points, [0, 0, 0])
    one = mark[np.isin(padded[mark + 1], [ord(c) for c in "stmd"])]
    pair = padded[mark + 1].astype(np.int64) * 256 + padded[mark + 2]
    two = mark[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]
    two = two[~row_start[two + 2]]
    begin[one + 1] = False
    begin[np.minimum(one + 2, n)] = True
    begin[two + 1] = False
    begin[np.minimum(two + 3, n)] = True
    return begin[:n]


def _below_plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return max(text) < chr(PLAIN)


class ByteTokens:
    """Ids of texts, with the pieces seen so far. Built once per Python worker and file."""

    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = _byte_symbols()
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = tuple(added)
        self.pieces = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(POOL, np.uint32)
        self.used = 0

    def _store(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        return starts, lengths

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Texts below ``PLAIN``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(piece_starts(points, bounds))
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(texts)
        ends = np.append(starts[1:], len(points))
        keys = A.slices(A.prefix(A.byte_values(points & 0xFF) + points.astype(np.uint64)), starts, ends)
        keys[keys == 0] = 1
        if self.used > 2 * POOL:
            self.clear()
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == keys
        at, length = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        new, first, back = np.unique(keys[~known], return_index=True, return_inverse=True)
        if len(new):
            where = np.flatnonzero(~known)[first]
            pieces = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[where], ends[where])]
            new_at, new_length = self._store([self.pieces.encode_ordinary(p) for p in pieces])
            at[~known], length[~known] = new_at[back], new_length[back]
            slots = slot[where]
            self.keys[slots], self.at[slots], self.length[slots] = new, new_at, new_length
        ids = self.pool[A.ragged(at, length)]
        ends = np.concatenate(([0], np.cumsum(length)))
        cut = ends[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        easy = [_below_plain(t) and not any(s in t for s in self.special) for t in texts]
        found = iter(self._encode_plain([t for t, e in zip(texts, easy) if e]))
        return [
            next(found) if e else np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32)
            for t, e in zip(texts, easy)
        ]


@lru_cache(maxsize=2)
def tokens(path: str) -> ByteTokens:
    return ByteTokens(path)
