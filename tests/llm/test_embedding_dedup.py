"""Embedding links against all cosines, and the recall of the index at the hardest cosine."""

from __future__ import annotations

import numpy as np

from helpers import SF
from topicwell.llm import embedding_dedup as E
from topicwell.llm.catalog import QUERIES


def brute(rows):
    usable = [E._usable(None if v is None else list(v)) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for length in {len(u) for u in usable if u is not None}:
        own = [i for i, u in enumerate(usable) if u is not None and len(u) == length]
        x = E.unit(np.array([usable[i] for i in own]))
        link[np.ix_(own, own)] = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(n)
    for _ in range(n):
        new = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    ids = [r[0] for r in rows]
    least = {k: min((ids[i] for i in range(n) if label[i] == k and ids[i] is not None), default=None) for k in set(label)}
    return sorted(((ids[i], int(link[i].sum()), least[label[i]]) for i in range(n)), key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in E.embedding_links(df).collect()), key=str)


def table(spark, rows, kind="float"):
    data = [(i, v, 3, "x", "y") for i, v in rows]
    schema = f"vec_id bigint, embedding array<{kind}>, size int, class string, near string"
    return spark.createDataFrame(data, schema).repartition(3)


def clusters(seed, kind=np.float64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(10):
        base = rng.standard_normal(16)
        for _ in range(int(rng.choice([1, 2, 9]))):
            rows.append((len(rows), (base + rng.choice([0, 0.01, 0.1]) * rng.standard_normal(16)).astype(kind).tolist()))
    return rows


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(1)
    n = len(rows)
    rows += [
        (n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [nan] + [1.0] * 15), (n + 4, [inf] + [1.0] * 15),
        (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e200, 2e200]),
        (n + 9, [-1.0, -2.0]), (None, rows[0][1]), (0, rows[0][1]), (None, [5.0, -1.0, 2.0]),
    ]
    assert found(table(spark, rows, "double")) == brute(rows)


def test_divided_lists(spark, monkeypatch):
    from topicwell.llm import tables

    rows = clusters(2)
    monkeypatch.setattr(tables.cells, "__defaults__", (2,))
    assert found(table(spark, rows, "double")) == brute(rows)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op2_embedding_dedup"](spark, SF).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert E.embedding_links(table(spark, [(1, [1.0])]).where("vec_id > 1")).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine just above 0.9 among spread vectors: at least 0.95 of them are linked."""
    rng = np.random.default_rng(3)
    a = E.unit(rng.standard_normal((1500, 64)))
    side = rng.standard_normal(a.shape)
    side = E.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))]
    links = sum(r.n_links for r in E.embedding_links(table(spark, rows, "double")).collect())
    assert 0.95 * 3000 <= links <= 3000


def test_recall_with_a_common_direction(spark, monkeypatch):
    """1024 pivots, and a cosine of 0.7 between vectors that have nothing else in common."""
    monkeypatch.setattr(E, "FEWEST", 1024)
    rng = np.random.default_rng(4)
    a = np.sqrt(0.3) * E.unit(rng.standard_normal((1500, 64)))
    a[:, 0] += np.sqrt(0.7)
    a = E.unit(a)
    side = np.sqrt(0.3) * E.unit(rng.standard_normal((1500, 64)))
    side = E.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))]
    x = E.unit(np.concatenate((a, b)))
    all_links = int((x @ x.T >= 0.9).sum()) - len(x)
    links = sum(r.n_links for r in E.embedding_links(table(spark, rows, "double")).collect())
    assert 0.98 * all_links <= links <= all_links


def test_agreement_is_a_plain_count():
    """Shared pivots and rank agreement of all members of a section against loops over the pairs."""
    rng = np.random.default_rng(5)
    near = np.array([rng.permutation(9)[:5] for _ in range(40)])
    near = near[((near == 2) | (near == 4)).sum(1) == 2]
    shared, agreement, earlier = E.section_agreement(near, 2, 4)
    for i, a in enumerate(near.tolist()):
        for j, b in enumerate(near.tolist()):
            if i == j:
                continue
            both = set(a) & set(b)
            assert shared[i, j] == len(both)
            assert agreement[i, j] == sum(5 - abs(a.index(p) - b.index(p)) for p in both)
            assert earlier[i, j] == any(p < 4 and p != 2 for p in both)
    count, score = E.pair_agreement(near[:-1], near[1:])
    assert (count == np.diagonal(shared, 1)).all() and (score == np.diagonal(agreement, 1)).all()


def test_order_of_pivots_decides(spark, monkeypatch):
    """Vectors that name the same pivots in other orders are told apart before a vector is fetched."""
    index = E.Index(np.zeros(3), np.eye(3), 3, 3, 9)
    monkeypatch.setattr(E, "choose_index", lambda *_: index)
    rows = [(0, [3.0, 2.0, 1.0]), (1, [3.0, 2.1, 1.0]), (2, [3.0, 3.1, 1.0])]
    assert E.unit(np.array([rows[1][1], rows[2][1]]))[0] @ E.unit(np.array([rows[2][1]]))[0] >= 0.9
    assert found(table(spark, rows, "double")) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]
