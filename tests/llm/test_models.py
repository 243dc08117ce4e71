"""Language identification and quality: held-out accuracy and odd input."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents
from topicwell.llm import arrays as A
from topicwell.llm import language_id as L
from topicwell.llm import quality as Q
from topicwell.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.01"


def block(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op4_language_id"](spark, SMALL).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_ignores_held_out_labels(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = rows.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang")))
    a = L.identify_languages(rows, fold).select("doc_id", "lang_pred", "score")
    b = L.identify_languages(other, fold).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_language_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of the"), (5, "ж"), (None, "the of"), (4, "the and of the")]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") == 4, "en"))
    got = {r.doc_id: r for r in L.identify_languages(docs, F.lit(False)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["en"] * 3
    none = L.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 7
    assert L.identify_languages(docs.where("doc_id > 9"), F.lit(False)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 40])
def test_code_words_differ(n):
    code = L.code_words(n)
    assert len({tuple(r) for r in code}) == n
    if n > 5:
        apart = (code[:, None] != code[None]).sum(2) + len(code[0]) * np.eye(n, dtype=int)
        assert apart.min() >= code.shape[1] // 5


def test_trigrams_do_not_cross_rows():
    texts = ["ab", "", "É!", "abc" * 50]
    together, rows = L.trigrams(*block(texts))
    for i, t in enumerate(texts):
        alone, _ = L.trigrams(*block([t]))
        assert together[rows[i] : rows[i + 1]].tolist() == alone.tolist()
    assert L.trigrams(*block(["É"]))[0].tolist() == L.trigrams(*block(["é"]))[0].tolist()


def rank_quality(score, label):
    order = np.argsort(np.argsort(score))
    good = label == 1
    return (order[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = QUERIES["op10_quality"](spark, SMALL).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    score, label = np.array(held).T
    print("quality: rows", len(label), "rank", rank_quality(score, label), "accuracy", ((score >= 0.5) == (label == 1)).mean())
    assert rank_quality(score, label) > 0.9 and ((score >= 0.5) == (label == 1)).mean() > 0.9


def test_quality_odd_input(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "word " * 50), (4, "!!!"), (None, "x"), (3, "word " * 50)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, text string")
    assert {r.score for r in Q.score_quality(docs, none, F.lit(False)).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (2, None), (1, 7), (None, 1), (99, 1)], "doc_id bigint, quality int")
    got = Q.score_quality(docs, some, F.lit(False)).collect()
    assert len(got) == 6 and all(0 < r.score < 1 for r in got)
    assert Q.score_quality(docs.where("doc_id > 9"), some, F.lit(False)).collect() == []


def test_additive_model_learns_shapes_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit_additive(x[:4000], y[:4000])
    assert (1, 0) in [p[:2] for p in model.pairs]
    assert ((model.score(x[4000:]) > 0.5) == (y[4000:] > 0)).mean() > 0.95
    y = (np.abs(x[:, 2] - 0.5) < 0.2).astype(float)
    model = Q.fit_additive(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == (y[4000:] > 0)).mean() > 0.95


def test_features_do_not_cross_rows():
    texts = ["A b!! b", "", "x", "é | é\n12 12 Long-word-of-many-letters.", " "]
    together = Q.features(*block(texts))
    assert np.isfinite(together).all() and together.shape[1] == len(Q.FEATURES)
    for row, text in zip(together, texts):
        assert np.allclose(row, Q.features(*block([text]))[0])
    assert A.BASE % 2


def test_a_label_on_many_rows_keeps_the_bound(spark, monkeypatch):
    """One labelled id on thousands of documents: the fit still sees no more rows than its limit."""
    docs = documents(spark, [(7, f"word {i} and more words") for i in range(900)] + [(i, f"other text {i}") for i in range(10, 60)])
    rows = docs.selectExpr("doc_id as id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in [7, *range(10, 60)]], "id bigint, label int")
    seen = []
    monkeypatch.setattr(Q, "fit_additive", lambda x, y: seen.append((len(x), len(y))))
    Q.learn_quality(rows, labels, limit=100)
    Q.learn_quality(rows, labels, limit=20)
    assert seen[0] == (100, 100) and seen[1][0] == 20
