"""Ranked search against plain scoring, and what is not unpacked."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from compare import connect, difference
from helpers import SF, documents
from topicwell.llm import ranked_search as R
from topicwell.llm.catalog import ORACLE, QUERIES


def terms(text):
    lowered = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered)


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n // length
            score = 0
            for t in terms(text):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda s: (s[0], s[1], 0 if s[1] else s[2]))[:top]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def cases(seed=0, docs=300):
    rng = random.Random(seed)
    words = [f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(2000)] + ["Été", "ÉTÉ", "a1B2", "x" * 300]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(docs)]
    out += [(docs + i, "w1, w2; w3\x00w4") for i in range(30)]  # ties
    out += [(900, None), (901, ""), (902, " \n-"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w5 w6"), (7, "w5 w6")]
    return out + [(903, "w7 " * 50_000 + "w8")]


ITEMS = [(0, "w1 w2"), (1, "W3 w3-w3 w50"), (2, None), (3, "nothing here"), (4, "été É w9"), (4, "x" * 300 + " a1b2"), (None, "w7 w8 w1 w2 w3 w4 w5")]


def asked(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "q", 1) for i, t in items], "item_id bigint, text string, id string, score int")


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("at_once, top", [(1024, 20), (2, 3)])
def test_cases(spark, at_once, top):
    got = found(R.ranked_search(documents(spark, cases()), asked(spark), top=top, at_once=at_once))
    assert got == brute(cases(), ITEMS, top)


def test_text_ids_and_empty_tables(spark):
    rows = [(f"d{i % 7}", f"w{i} w1") for i in range(40)] + [(None, "w1")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(R.ranked_search(docs, asked(spark))) == brute(rows, ITEMS)
    assert found(R.ranked_search(documents(spark, []), asked(spark))) == []
    assert found(R.ranked_search(documents(spark, [(1, None)]), asked(spark))) == []
    assert found(R.ranked_search(documents(spark, cases()), asked(spark, []))) == []


def test_blocks_come_back():
    rng = np.random.default_rng(0)
    for most in (200, 60_000):
        for size in (1, 2, 128):
            places = np.sort(rng.choice(most, size, replace=False))
            for high in (3, 300, 70_000):
                tf = rng.integers(1, high, size)
                again = R.unpack(int(places[0]), R.pack(places, tf))
                assert (again[0] == places).all() and (again[1] == tf).all()


def test_bounds_keep_blocks_packed(monkeypatch):
    """Same heaps with and without bounds; with them, common terms stay packed where no candidate can profit."""
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = np.random.default_rng(1)
    n, vocabulary = 4000, 30
    rows = [np.flatnonzero(rng.random(vocabulary) < 1 / (1 + np.arange(vocabulary))).astype(np.int32) for _ in range(n)]
    table = pa.table(
        {
            "id": pa.array(rng.permutation(n)),
            "m": pa.array(rng.integers(75, 400, n)),
            "terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
            "tfs": pa.array([rng.integers(1, 6, len(r)).tolist() for r in rows], pa.list_(pa.int32())),
        }
    )
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in r for r in rows) + 1))) for t in range(vocabulary)])
    best = np.full(vocabulary, R.share(np.array(5), np.array(75)))
    parts = [R.segment(table.slice(i, 500)).to_pylist()[0] for i in range(0, n, 500)]

    def run(bounds):
        terms = np.array([0, 1, 2, 15, 25])
        query = R.Query(0, terms, weights[terms], bounds[terms])
        unpacked = blocks = 0
        for part in parts:
            segment = R.Segment.read(part)
            R.search_segment(query, segment, 20)
            unpacked += len(segment.unpacked)
            blocks += sum(len(range(*segment.blocks(t).indices(10**9))) for t in terms.tolist())
        return query.heap, unpacked, blocks

    bounded, unpacked, blocks = run(weights * best)
    plain, all_unpacked, _ = run(np.full(vocabulary, 1 << 60))
    assert bounded == plain and all_unpacked == blocks
    assert unpacked < 0.5 * blocks


def test_query_agrees_with_sql(spark):
    assert difference(QUERIES["op12_ranked_search"](spark, SF), connect(SF), ORACLE["op12_ranked_search"]) is None
