"""The pipeline stage by stage: what goes, what stays, and odd rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from helpers import SF, WORD, written
from topicwell.llm.exact_dedup import _normalised
from topicwell.llm.tables import settle

COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(settle(stage(spark, out[-1], path), name))
    return out


def test_stages(spark):
    tables = stages(spark, SF)
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    assert all(sorted(t.columns) == COLUMNS for t in tables[:-1])
    text = {r["doc_id"]: r["text"] for r in rows[0]}
    for before, after in zip(rows[:3], rows[1:4]):
        assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        assert all(r["text"] == text[r["doc_id"]] for r in after)
    clean = [r for r in rows[0] if r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(rows[1]) >= 0.98 * len(clean)
    last = {_normalised(r["text"]): r["doc_id"] for r in sorted(rows[1], key=lambda r: r["doc_id"])}
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(last.values())
    from test_ngram_join import brute

    near = brute([(r["doc_id"], r["text"]) for r in rows[2]])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(i for i, c, _, _ in near if i == c)
    mixed, want = Counter(), Counter()
    for r in rows[4]:
        assert r["n_chars"] == len(r["text"])
        mixed[r["doc_id"], *WORD.findall(r["text"].encode())] += 1
    for r in cp.mix_sources(tables[3], ranges=True).collect():
        words = WORD.findall(text[r.doc_id].encode())
        for copy in range(max((t.times for t in r.ranges), default=0)):
            want[r.doc_id, *[w for t in r.ranges if t.times > copy for w in words[t.first : t.first + t.words]]] += 1
    assert mixed == want and any(len(w) - 1 < len(WORD.findall(text[w[0]].encode())) for w in mixed)
    used = defaultdict(int)
    for r in rows[5]:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and Counter(r["piece"] for r in rows[5])[0] == len(rows[4])


def test_odd_rows(spark, tmp_path):
    """Shared and missing ids, repeated rows, nulls and a clashing extra column."""
    words = " ".join(f"the and with this word{i}" for i in range(30))
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 60")
    odd = [(1, words), (1, words), (1, words + " more"), (None, words.upper()), (None, None), (2, ""), (3, "12 34"), (None, "the with of and " + words)]
    extra = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], base.schema)
    more = ["id", "size", "_row", "__Row", "_words", "_size", "_taken", "_mixed", "_k__row", "_metadata", "_ranges", "_copy"]
    docs = base.unionByName(extra).selectExpr("*", *[f"{c} as {n}" for c, n in zip(["doc_id", "text"] * 6, more)])
    path = written(spark, tmp_path, "documents", docs)
    tables = stages(spark, path)
    assert all(sorted(t.columns) == sorted([*COLUMNS, *more]) for t in tables[:-1])
    group = tables[3].where("text ilike '%word29%'").collect()
    assert len(group) == 1 and tables[1].where("text is null or text in ('', '12 34')").count() == 0
    assert tables[5].count() > 0


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    assert cp.run(spark, written(spark, tmp_path, "documents", docs)).collect() == []


def shuffled(spark, plan, column):
    """Rows that all exchanges holding the column have written."""
    name, rows = plan.getClass().getSimpleName(), 0
    if name == "AdaptiveSparkPlanExec":
        return shuffled(spark, plan.executedPlan(), column)
    if name.endswith("QueryStageExec"):
        return shuffled(spark, plan.plan(), column)
    output = plan.output()
    if name == "ShuffleExchangeExec" and column in {output.apply(i).name() for i in range(output.size())}:
        rows = plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    return rows + sum(shuffled(spark, children.apply(i), column) for i in range(children.size()))


def test_mix_moves_only_texts_of_sources_taken_in_many_ways(spark, tmp_path):
    """Of four sources two are at their limit: with a list too long to send, only the texts of the others are shuffled."""
    rng = random.Random(5)
    size = {"a": 600, "b": 200, "c": 200, None: 200}
    rows = [
        (i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 160))), source)
        for i, source in enumerate(s for s, n in size.items() for _ in range(n))
    ]
    odd = [(5000, None, "a"), (5001, None, "c"), (5002, " ", None), (None, "w1 w2 ", "c"), (None, "w1 w2 ", "c"), (7, "w3", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, source string").repartition(3)
    docs = settle(docs, "documents")

    def mixed(**limits):
        for key, value in limits.items():
            spark.conf.set(key.replace("__", "."), value)
        try:
            out = cp.mix(spark, docs, "")
            found = Counter(map(tuple, out.collect()))
            return found, shuffled(spark, out._jdf.queryExecution().executedPlan(), "text")
        finally:
            for key in limits:
                spark.conf.unset(key.replace("__", "."))

    want = Counter()
    text = {(i, t, s): WORD.findall((t or "").encode()) for i, t, s in rows + odd}
    for r in cp.mix_sources(docs.selectExpr("struct(doc_id, text, source) AS doc_id", "text", "source", "doc_id AS h"), hash_col="h", ranges=True).collect():
        words = text[tuple(r.doc_id)]
        for copy in range(max((t.times for t in r.ranges or []), default=0)):
            want[r.doc_id.doc_id, r.doc_id.source, *[w for t in r.ranges if t.times > copy for w in words[t.first : t.first + t.words]]] += 1
    none = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
    runs = [mixed(**none, spark__topicwell__llm__keyRows=n) for n in ("100000", "60", "0")]
    for found, _ in runs:
        got = Counter()
        for (i, t, s), n in found.items():
            got[i, s, *WORD.findall(t.encode())] += n
        assert got == want
    at_limit = sum(s in ("c", None) for _, _, s in rows + odd)
    assert [moved for _, moved in runs] == [0, len(rows + odd) - at_limit, len(rows + odd)]
