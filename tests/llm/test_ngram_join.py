"""The similarity join against all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import SF, WORD, documents
from topicwell.llm import ngram_join as N
from topicwell.llm.catalog import QUERIES


def shingle_set(text, size=5):
    words = WORD.findall((text or "").encode())
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else None


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    late = float("inf")
    ids = [late if i is None else i for i, _ in rows]
    links = [0] * len(rows)
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least, same = {}, {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), late), ids[a])
        key = sets[a] or ("row", a)
        same[key] = min(same.get(key, late), ids[a])
    none = lambda x: None if x == late else x
    return sorted(
        ((rows[a][0], none(least[find(a)]), none(same[sets[a] or ("row", a)]), links[a]) for a in range(len(rows))),
        key=str,
    )


def edited(seed, groups=12):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((at, " ".join(words)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one two"), (at + 4, "one  two"), (None, "one two")]
    return rows + [rows[0], rows[0]]


def found(df):
    return sorted(((r.doc_id, r.class_id, r.set_id, r.n_links) for r in N.ngram_links(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    rows = edited(seed)
    assert found(documents(spark, rows)) == brute(rows)


def test_divided_groups(spark, monkeypatch):
    """Cells of two rows a side, shuffled key joins and rows of few pairs give the same links."""
    from topicwell.llm import tables

    rows = edited(3, 6)
    monkeypatch.setattr(tables.cells, "__defaults__", (2,))
    monkeypatch.setattr(N, "ROW_PAIRS", 2)
    spark.conf.set("spark.topicwell.llm.keyRows", "0")
    try:
        assert found(documents(spark, rows)) == brute(rows)
    finally:
        spark.conf.unset("spark.topicwell.llm.keyRows")


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id, r.set_id, r.n_links) for r in QUERIES["op1_ngram_join"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert N.ngram_links(documents(spark, [(1, "a")]).where("doc_id > 1")).collect() == []


def test_intersections_by_product():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, 6000).astype(np.uint64)) for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(left, right)]
    assert N.intersections(sets, left, right).tolist() == want
    assert N.intersections(sets, left[:5], right[:5]).tolist() == want[:5]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    pairs, values = 20_000, N.BANDS * N.VALUES
    for similarity, least, most in ((0.8, 0.999, 1), (0.95, 1, 1), (0.3, 0, 0.001)):
        sketch = rng.integers(0, 256, (2 * pairs, values), dtype=np.uint8)
        agree = rng.random((pairs, values)) < similarity
        sketch[1::2] = np.where(agree, sketch[::2], sketch[1::2])
        left, _ = N.pruned_pairs(sketch, np.arange(0, 2 * pairs, 2), np.arange(1, 2 * pairs, 2), 0.8)
        assert least <= len(left) / pairs <= most
