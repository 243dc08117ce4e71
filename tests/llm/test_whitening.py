"""Whitening against a dense eigenvalue decomposition."""

from __future__ import annotations

import random

import numpy as np
import pytest

from topicwell.llm import whitening as W
from topicwell.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    data = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>, id string, n int").repartition(3)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) and abs(64 * x) < 2**62 for x in v)


def check(got, rows, components=32):
    """``got`` against the eigenvectors of the covariance of ``rows``, all of one length."""
    rows = sorted(((i, v) for i, v in rows if usable(v)), key=str)
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    c = (scaled / n).astype(np.float64)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    kept = min(components, int((e > 1e-12 * e[0]).sum()))
    got = sorted(got, key=lambda r: (r.deviation, round(abs(r.whitened), 6), r.component))
    assert len(got) == n * kept and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, kept + 1))
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(kept):
        own = [r for r in got if r.component == k + 1]
        assert all(abs(r.explained / (e[k] / e.sum()) - 1) < 1e-6 for r in own)
        wanted = c @ u[:, k] / np.sqrt(e[k])
        apart = min(abs(e[k] - e[j]) for j in range(len(e)) if j != k) / e[0]
        if apart > 1e-6:
            assert np.allclose(sorted(abs(r.whitened) for r in own), sorted(abs(wanted)), atol=1e-7)
    deviations = sorted(r.deviation for r in got if r.component == 1)
    assert deviations == sorted(int(v) for v in (scaled**2).sum(1))


def vectors(seed, n, dims, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank or dims)) * np.arange(1, (rank or dims) + 1)
    x = x @ rng.standard_normal((rank or dims, dims)) if rank else x
    return [(i, r.tolist()) for i, r in enumerate(x + 5)]


@pytest.mark.parametrize("n, dims, rank, components", [(200, 6, None, 32), (150, 12, None, 4), (5, 8, None, 32), (90, 10, 3, 32)])
def test_components(spark, n, dims, rank, components):
    rows = vectors(n, n, dims, rank)
    if rank:
        # Whole numbers keep the rank.
        rows = [(i, [float(round(x)) for x in v[:rank]]) for i, v in rows]
        rows = [(i, v + [sum(v)] * (dims - rank)) for i, v in rows]
    check(W.whiten(table(spark, rows), components=components).collect(), rows, components)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i, 3]), [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 3)]) for i in range(60)]
    rows += rows[:10] + [(70, None), (71, []), (72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 2.0]), (74, [1.0, float("inf"), 2.0])]
    rows += [(75, [1.0, 2.0, 1e300])]
    check(W.whiten(table(spark, rows)).collect(), rows)


def test_no_deviation_and_empty_table(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert W.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []


def test_lengths_are_lists_of_their_own(spark):
    two, three = vectors(1, 40, 2), [(100 + i, v) for i, v in vectors(2, 50, 3)]
    got = W.whiten(table(spark, two + three)).collect()
    check([r for r in got if r.vec_id < 100], two)
    check([r for r in got if r.vec_id >= 100], three)


def test_large_entries_are_exact(spark):
    rows = [(i, [2.0**50 * x for x in v]) for i, v in vectors(4, 40, 3)]
    got = W.whiten(table(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-9
    rows = [(i, [2.0**10 * x for x in v]) for i, v in vectors(4, 40, 3)]
    check(W.whiten(table(spark, rows)).collect(), rows)


def test_equal_eigenvalues_start_again():
    """Vectors that vanish before all dimensions are used: a multiple of the identity, and a null space."""
    for x in (np.eye(7) * 3, np.diag([5.0, 5, 5, 1, 1, 0, 0]), np.outer(np.arange(5.0), np.arange(4.0))):

        def product(short, p):
            u = x @ p
            return np.concatenate(((x @ short).T @ u, [u @ u], x.T @ u))

        vectors, sizes = W.bidiagonalise(product, x.shape[1], 32)
        assert np.allclose(sizes, np.linalg.svd(x)[1], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(x.shape[1]), atol=1e-12)
        assert np.allclose(np.linalg.norm(x @ vectors, axis=0), sizes, atol=1e-12)


def test_ends_early_when_the_wanted_ones_are_found():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 120)) * 0.5 ** np.minimum(np.arange(120), 40)
    passes = []

    def product(short, p):
        passes.append(1)
        u = x @ p
        return np.concatenate(((x @ short).T @ u, [u @ u], x.T @ u))

    vectors, sizes = W.bidiagonalise(product, 120, 5)
    assert len(passes) < 60
    assert np.allclose(sizes[:5], np.linalg.svd(x)[1][:5], rtol=1e-12)


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding]
    check(QUERIES["op13_embedding_whitening"](spark, SF).collect(), rows)
