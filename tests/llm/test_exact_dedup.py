"""Exact groups against plain grouping, also with fingerprints that collide."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from compare import connect, difference
from helpers import SF, documents, sha
from topicwell.llm import exact_dedup as X
from topicwell.llm.catalog import ORACLE, QUERIES


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[X._normalised(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[X._normalised(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(X._normalised(t))))
    return sorted(out, key=str)


def cases():
    rng = random.Random(0)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    rows = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, " "), (7, "x"), (7, "x"), (None, "only"), (None, "only")]
    return rows + [(8, long), (9, long.upper()), (10, long + "."), (None, long), (11, "a" * 200_000), (12, "A" * 200_000)]


def found(df):
    rows = X.exact_groups(df).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=str)


def test_cases(spark):
    assert found(documents(spark, cases())) == brute(cases())


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 300_000).astype(np.uint8)
    ends = X.chunk_ends(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes[:-1].min() >= X.LEAST and sizes.max() <= X.MOST
    moved = X.chunk_ends(np.concatenate((text[:10], text)))
    assert len({len(text) - e for e in ends} & {len(text) + 10 - e for e in moved}) > 0.9 * len(ends)


def test_one_fingerprint_for_all(spark, monkeypatch):
    """Chunks with one fingerprint are told apart by their bytes."""
    path = X.__file__
    with open(path) as file:
        source = file.read()
    assert "_fingerprint(c)" in source
    weak = {}
    exec(compile(source.replace("hashlib.blake2b(chunk, digest_size=16).digest()", 'b"same"'), "weak", "exec"), weak)
    rows = [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in weak["exact_groups"](documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_shuffled_joins(spark):
    spark.conf.set("spark.topicwell.llm.keyRows", "0")
    try:
        assert found(documents(spark, cases())) == brute(cases())
    finally:
        spark.conf.unset("spark.topicwell.llm.keyRows")


def test_empty_table(spark):
    assert found(documents(spark, [(1, "a")]).where("doc_id > 1")) == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None
