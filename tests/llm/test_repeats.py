"""Passages and repeated strings against brute force over all windows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, WORD, documents, passages, sha
from topicwell.llm import arrays as A
from topicwell.llm import repeats, substring_dedup
from topicwell.llm import suffix_dedup as suffix_dedup_module
from topicwell.llm.substring_dedup import factor_dedup
from topicwell.llm.suffix_dedup import suffix_array, suffix_dedup


def words_left(rows, window):
    found = {}
    texts = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    late = float("inf")
    for i, ws in texts:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            found[key] = min(found.get(key, late), late if i is None else i)
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if found[tuple(ws[p : p + window])] < (late if i is None else i):
                gone[p : p + window] = [True] * window
        out.append((i, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def bytes_left(rows, width):
    found = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for p in range(len(t) - width + 1):
            found[t[p : p + width]] += 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - width + 1):
            if found[t[p : p + width]] > 1:
                gone[p : p + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check_words(df, rows, window, **kw):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in factor_dedup(df, window=window, **kw).collect()]
    assert order(got) == order(words_left(rows, window))


def check_bytes(df, rows, width, **kw):
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes))
        for r in suffix_dedup(df, width=width, **kw).collect()
    ]
    assert order(got) == order(bytes_left(rows, width))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rows = passages(seed)
    df = documents(spark, rows)
    check_words(df, rows, 13)
    check_bytes(df, rows, 40, gram=12)


def test_shuffled_joins_and_short_segments(spark, monkeypatch):
    """The way taken beyond the broadcast check, and runs cut at segments, give the same rows."""
    rows = passages(3)
    spark.conf.set("spark.topicwell.llm.keyRows", "0")
    try:
        check_words(documents(spark, rows), rows, 13)
        check_bytes(documents(spark, rows), rows, 40, gram=12)
    finally:
        spark.conf.unset("spark.topicwell.llm.keyRows")


def test_segments_do_not_change_runs_found(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    spec = repeats.Windows(20, 6, lambda b, o: (A.byte_values(b), o), "uint8", True)
    bounds = np.array([0, 100, 100, 110, 500])
    for segment in (1 << 20, 64):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        row, start, length, *_ = repeats.runs(A.byte_values(text), bounds, spec)
        covered = {(int(r), int(s) + i) for r, s, n in zip(row, start, length) for i in range(n)}
        assert covered == {(r, p) for r in range(4) for p in range(bounds[r + 1] - bounds[r] - 19)}


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (None, text), (3, "a " * 30), (5, "x " + text), (2, None)]
    check_words(documents(spark, rows), rows, 13)
    check_bytes(documents(spark, rows), rows, 40, gram=12)


def test_a_third_without_id(spark):
    """Ranges and runs are gathered per text: rows without id do not meet, and rows alike gather once."""
    rows = [(None if i % 3 == 0 else i, t) for i, t in passages(4, 90)] + [(None, passages(4)[7][1])] * 20
    df = documents(spark, rows)
    check_words(df, rows, 13)
    check_bytes(df, rows, 40, gram=12)
    pairs = df.select(F.col("doc_id").alias("id"), "text")
    spec = repeats.Windows(40, 12, suffix_dedup_module._byte_symbols, "uint8", True)
    twice = F.col("n") >= 2
    found = repeats.removed_ranges(
        pairs, spec, suffix_dedup_module.repeated_windows, twice, ~twice, twice, F.col("total") >= 2
    ).select("key.id", "key.row_key", F.size("ranges").alias("n"))
    assert found.groupBy("id", "row_key").count().where("count > 1").count() == 0
    longest = max(len(t or "") for _, t in rows)
    assert found.agg(F.max("n")).first()[0] <= 4 * longest / 40 + 4 and found.where("id IS NULL").count() > 5


def test_empty_table(spark):
    df = documents(spark, [(1, "a")]).where("doc_id > 1")
    assert factor_dedup(df).collect() == [] and suffix_dedup(df).collect() == []


def test_whole_tables_against_brute_force(spark):
    from topicwell.llm.catalog import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, SF).collect()}
    want = {i: (n, g, sha(k)) for i, n, g, k in words_left(rows, 13)}
    assert got == want and sum(g for _, g, _ in want.values()) > 0
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in QUERIES["op9_suffix_dedup"](spark, SF).collect()
    }
    want = {i: (n, g, s, sha(k)) for i, n, g, s, k in bytes_left(rows, 200)}
    assert got == want and sum(g for _, g, _, _ in want.values()) > 0


@pytest.mark.parametrize("symbols", [2, 4, 200])
def test_suffix_array(symbols):
    rng = np.random.default_rng(symbols)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 31, 100, 333]:
        for text in (rng.integers(1, symbols, n), np.ones(n, int), np.tile([1, 2], n)[:n]):
            assert list(suffix_array(text)) == sorted(range(n), key=lambda i: list(text[i:]))


def bounded(compare, most):
    """``compare``, which fails if a task is handed more symbols than ``most``."""

    def run(symbols, *rest):
        if len(symbols) > most:
            raise ValueError(f"{len(symbols)} symbols in one comparison")
        return compare(symbols, *rest)

    return run


def test_line_in_a_third_of_the_documents(spark, monkeypatch):
    """One mark with a different content per occurrence is not one task's share."""
    line, passage = "held by many documents of this table", " ".join(f"p{i}" for i in range(20))
    rows = []
    for i in range(240):
        own = [f"o{i}n{k}" for k in range(30)]
        shared = line if i % 3 == 0 else passage if i % 3 == 1 else ""
        rows.append((i if i % 7 else None, " ".join([*own[:15], shared, *own[15:]])))
    rows += [(500, "loop la " * 60), (501, "x " + "loop la " * 50), rows[1]]
    monkeypatch.setattr(repeats, "COMPARED", 1 << 9)
    monkeypatch.setattr(repeats, "WIDE", 1 << 8, raising=False)
    monkeypatch.setattr(substring_dedup, "factor_windows", bounded(substring_dedup.factor_windows, 1 << 11))
    monkeypatch.setattr(suffix_dedup_module, "repeated_windows", bounded(suffix_dedup_module.repeated_windows, 1 << 11))
    df = documents(spark, rows)
    check_words(df, rows, 13)
    check_bytes(df, rows, 40, gram=12)
