"""Bin completion on shards in which cut documents leave thousands of full pieces."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from topicwell.llm import packing as P


def packed(lengths):
    bins = P.complete_bins(lengths, P.CAPACITY)
    assert Counter(x for b in bins for x in b) == Counter(lengths)
    assert all(sum(b) <= P.CAPACITY for b in bins)
    return len(bins)


def test_full_pieces_do_not_use_up_the_search():
    rest = [517, 266, 261] * 438 + [246] * 876
    assert packed([P.CAPACITY] * 6000 + rest) == 6657
    assert packed([1000] * 6000 + rest) == 6657
    assert packed(rest) == 657


def test_only_bins_of_one_piece():
    assert packed([]) == 0
    assert packed([P.CAPACITY] * 7000) == 7000
    assert packed([600] * 3 + [P.CAPACITY]) == 4


def test_places_of_full_pieces():
    lengths = np.array([1024, 500, 1024, 524, 1024, 3])
    number, offset = P.pack_lengths(lengths, 1024)
    spans = sorted(zip(number.tolist(), offset.tolist(), lengths.tolist()))
    assert len(set(number.tolist())) == 5
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


HARD = [520, 513, 422, 420, 341, 330, 291, 263, 230, 216, 195, 96, 91, 83, 38, 27, 20]


def test_every_filling_is_tried():
    assert P.search_bins(HARD, P.CAPACITY) == P.Packing(P.search_bins(HARD, P.CAPACITY).bins, True)
    assert packed(HARD) == 4
    rng = random.Random(0)
    for _ in range(200):
        bins = rng.randrange(3, 6)
        lengths = []
        for _ in range(bins):
            cuts = sorted(rng.sample(range(1, P.CAPACITY), rng.randrange(3, 8)))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, P.CAPACITY])]
        found = P.search_bins(lengths, P.CAPACITY, nodes=200_000)
        assert len(found.bins) == bins and found.proven and Counter(x for b in found.bins for x in b) == Counter(lengths)


def test_fillings_against_subsets():
    """All maximal fillings, or one that dominates each of those left out; the waste never exceeds the limit."""
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room, most = rng.randrange(1, 60), rng.randrange(0, 12)
        found = [f for f in P._Left(lengths, 64).fillings(room, most) if f is not None]
        wanted = set()
        for chosen in range(1 << len(lengths)):
            own = tuple(sorted((x for i, x in enumerate(lengths) if chosen >> i & 1), reverse=True))
            others = [x for i, x in enumerate(lengths) if not chosen >> i & 1]
            waste = room - sum(own)
            if 0 <= waste <= most and not any(x <= waste for x in others):
                wanted.add(own)
        assert set(found) <= wanted and len(set(found)) == len(found)
        assert all(f in found or any(P._fits_into(f, g) for g in found) for f in wanted)


def test_the_limit_ends_the_search():
    """With few nodes the incumbent stands, complete, and is not called proven."""
    rng = random.Random(2)
    lengths = [rng.randrange(180, 700) for _ in range(400)]
    found = P.search_bins(lengths, P.CAPACITY, nodes=10, descents=0)
    assert not found.proven and Counter(x for b in found.bins for x in b) == Counter(lengths)
    assert len(found.bins) <= len(P.best_fit(lengths, P.CAPACITY))
