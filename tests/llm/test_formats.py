"""Formatting, mixing and packing: round trips, plain models and conserved quantities."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import SF, WORD, documents, sha
from topicwell.llm import chat_format as C
from topicwell.llm import mixing as M
from topicwell.llm import packing as P
from topicwell.llm import tokens as T
from topicwell.llm.catalog import QUERIES
from topicwell.llm.tables import settle

HARD = st.lists(
    st.sampled_from([*"<>[]/\\|s:1", "</s>", "INST]", "[/INST]", "<|end|>", "<|turn|>", "|image:0|>", "é", "\n"])
).map("".join)


# Formatting


@given(HARD)
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = C.escape(text)
    assert C.unescape(hidden) == text
    assert not any(s in hidden for s in (C.TURN, C.BODY, C.END, "</s>", "<s>", "[INST]", "[/INST]", "<|image:0|>"))


@given(st.lists(st.tuples(HARD, st.lists(HARD, max_size=3))))
@settings(max_examples=200, deadline=None)
def test_turns_are_read_back(turns):
    done = C.Flattened({})
    for role, parts in turns:
        done.turn(role, [{"type": "text", "text": t, "ref": None, "units": None} for t in parts])
    assert C.read_turns("".join(done.pieces)) == [(role, "".join(parts)) for role, parts in turns]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png", 1.5), part(None, "<|image:0|>"), None]),
        (1, 1, "assistant", [part("text", "ok </s>"), part("audio", None, "b.wav", 2.0), part("text", "done")]),
        (2, 0, "user", [part("document", None, "c.pdf", None)]),
        (2, 1, "assistant", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts array<{C.PART}>")
    got = {r.conv_id: r for r in C.format_parts(df).collect()}
    one = got[1]
    assert [(a["type"], a["ref"], a["turn"], a["tokens"]) for a in one.attachments] == [("image", "a.png", 0, 384), ("audio", "b.wav", 1, 50)]
    for a in [*one.attachments, *got[2].attachments]:
        assert got[1 if a["ref"] != "c.pdf" else 2].formatted[a["at"] :].startswith(f"<|{a['type']}:{a['number']}|>")
    assert C.read_loss(one.formatted, one.loss_spans) == "ok </s>done"
    assert one.formatted.count("<|image:0|>") == 1 and got[2].attachments[0]["tokens"] == 0 and got[2].n_turns == 2
    with pytest.raises(Exception, match="unknown content part"):
        C.format_parts(df.withColumn("parts", F.array(F.struct(F.lit("video").alias("type"), *[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("ref", "string"), ("units", "double"))])))).collect()


def test_conversations_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    conversations = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        conversations[conv].append((role, text or ""))
    got = QUERIES["op6_chat_format"](spark, SF).collect()
    assert len(got) == len(conversations)
    for r in got:
        turns = conversations[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode())) and r.formatted_chars > len(loss)


def test_odd_turns(spark):
    rows = [(None, 0, "user", "a", 1), (1, None, None, None, 1), (1, 2, "assistant", "b", 1), (1, 2, "assistant", "b", 1), (None, 1, "user", "c", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, parts int")
    got = {r.conv_id: C.read_turns(r.formatted) for r in C.format_turns(df).collect()}
    assert got == {None: [("user", "a"), ("user", "c")], 1: [("", ""), ("assistant", "b"), ("assistant", "b")]}
    assert C.format_turns(df.where("turn > 9")).collect() == []


# Mixing


def model_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2.0 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = [s for s in free if target[s] > 2.0 * sizes[s]]
        if not above:
            return target
        full |= set(above)


def check_mix(rows, got, block, shard_rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall((text or "").encode()))
    want = sorted((str(i), len(WORD.findall((t or "").encode())), sizes[s]) for i, t, s in rows)
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == want
    targets = sorted(model_targets(sizes).values())
    taken, seen = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target, r.source_size] += r.taken
        seen[r.target, r.source_size] = r.target
    assert np.allclose(sorted({round(t, 6) for t in targets}), sorted({round(t, 6) for t in seen.values()}))
    shards = len(rows) // shard_rows + 1
    same = defaultdict(int)
    for s, t in model_targets(sizes).items():
        same[round(t, 6), sizes[s]] += 1
    for (t, size), n in taken.items():
        count = same[round(t, 6), size]
        assert abs(n - t * count) <= block * (shards + 2) * count


def mixed_rows(seed):
    rng = random.Random(seed)
    names = ["a", "B", "b", "é", None, "z0", "", "huge"]
    rows = []
    for i in range(300):
        source = "huge" if rng.random() < 0.4 else rng.choice(names)
        words = 0 if rng.random() < 0.1 else rng.randrange(1, 40) if rng.random() < 0.95 else 2000
        rows.append((i, None if rng.random() < 0.02 else "\t".join(["w"] * words), source))
    return rows + [rows[0], rows[0], (None, "a b c", "a"), (5, "", "empty"), (5, "", "empty"), (6, None, "empty")]


def source_docs(spark, rows):
    data = [(i, t, s, 1, 2, "x") for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, size int, shard int, member string").repartition(4)


@pytest.mark.parametrize("block,shard_rows", [(16, 10**6), (8, 25)])
def test_mix(spark, block, shard_rows):
    rows = mixed_rows(1)
    docs = source_docs(spark, rows)
    got = M.mix_sources(docs, block=block, shard_rows=shard_rows).collect()
    check_mix(rows, got, block, shard_rows)
    again = M.mix_sources(docs.repartition(7), block=block, shard_rows=shard_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_ranges_tile_the_documents(spark):
    got = M.mix_sources(source_docs(spark, mixed_rows(2)), block=8, shard_rows=25, ranges=True).collect()
    assert any(len(r.ranges or []) > 2 for r in got)
    for r in got:
        at = 0
        for run in r.ranges or []:
            assert run.first == at and 0 < run.words <= 8 and 0 <= run.times <= M.REPEATS
            at += run.words
        assert at == r.size and sum(run.words * run.times for run in r.ranges or []) == r.taken


def shared_id_rows(many):
    """A third of the rows without id and alike, a third of one id with texts of their own."""
    rows = [(None, "w w w w w", "a")] * many + [(7, "w " * (i % 9 + 1) + str(i), "a") for i in range(many)]
    return rows + [(100 + i, "w w w", "ab"[i % 2]) for i in range(many)]


def test_mix_spreads_rows_that_share_an_id(spark):
    rows = shared_id_rows(2000)
    docs = source_docs(spark, rows)
    sized = settle(docs.selectExpr("doc_id id", "xxhash64(doc_id) hash", "source", "size(split(text, ' ')) size", "xxhash64(text) text_hash"), "sizes")
    held = [r["count"] for r in M._spread(sized, 200).groupBy(F.expr("pmod(hash, 30)")).count().collect()]
    assert sum(held) == len(rows) and len(held) == 30 and max(held) <= 2 * sorted(held)[15]
    got = M.mix_sources(docs, block=16, shard_rows=200).collect()
    check_mix(rows, got, 16, 200)
    again = M.mix_sources(docs.repartition(7), block=16, shard_rows=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 40, 200):
        votes = {f"s{i}": rng.choice([0.0, 5.0, 5.0, rng.random() * 100]) for i in range(12)}
        wins = sorted(((-v / (2 * k + 1), s) for s, v in votes.items() for k in range(seats) if v), key=lambda x: x)[:seats]
        want = {s: sum(1 for _, w in wins if w == s) for s in votes}
        data = [(s, v, 10**6, seats, sum(votes.values()), len(votes), 1) for s, v in votes.items()]
        df = spark.createDataFrame(data, "member string, votes double, most bigint, seats bigint, all_votes double, members bigint, g int")
        for within in ([], ["g"]):
            got = {r.member: r.quota for r in M._apportioned(df, within, F.col("member").asc()).collect()}
            assert got == want


def test_mix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(rows, QUERIES["op7_source_mixing"](spark, SF).collect(), M.BLOCK, M.SHARD_ROWS)


def test_mix_empty_tables(spark):
    assert M.mix_sources(source_docs(spark, mixed_rows(1)).where("doc_id < 0")).collect() == []
    got = M.mix_sources(source_docs(spark, [(1, None, None), (2, "", "x")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# Packing


def check_packing(rows, got, capacity=1024):
    plain = Tokenizer.from_file(T.default_path())
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    want = defaultdict(list)
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        want[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in p) for i, p in pieces.items()} == {i: sorted(w) for i, w in want.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    used, _ = check_packing(rows, got)
    lengths = [r.length for r in got]
    assert used <= len(P.best_fit(lengths, 1024)) and used <= 1.02 * P.lower_bound(lengths, 1024) + 1


def test_packing_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "x" * 5000), (3, "it's they'll"), (3, "it's they'll"), (4, "日本 <|endoftext|> é" * 300), (5, " \n\n  a")]
    check_packing(rows, P.pack_documents(documents(spark, rows), capacity=64, shard_pieces=4).collect(), 64)
    ids = P.pack_documents(documents(spark, rows), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)
    assert P.pack_documents(documents(spark, rows).where("doc_id > 9")).collect() == []


def test_packing_spreads_rows_alike(spark):
    rows = [(None, None)] * 2000 + [(i, "a b") for i in range(2000)]
    got = P.pack_documents(documents(spark, rows), shard_pieces=200).collect()
    check_packing(rows, got)
    held = sorted(Counter(r.sequence_id >> 32 for r in got).values())
    assert len(held) == 20 and held[-1] <= 2 * held[10]


def test_pieces_follow_the_pattern():
    encoder = T.tokens(T.default_path())
    rng = random.Random(1)
    letters = list(" '  \n\tabcdelmrstvéÀÿ¹²½12\x85\xa0.,!?'''-") + ["'s", "'re", "'ll", " '", "<|endoftext|>", "日", "\x1c", "ſ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(ids) == encoder.plain.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=300, deadline=None)
def test_bin_completion_is_optimal_on_small_input(lengths):
    def least(rest, rooms):
        if not rest:
            return len(rooms)
        head, rest = rest[0], rest[1:]
        found = [least(rest, (*rooms, 20 - head))]
        for i in {r: i for i, r in enumerate(rooms) if r >= head}.values():
            found.append(least(rest, (*rooms[:i], rooms[i] - head, *rooms[i + 1 :])))
        return min(found)

    lengths = sorted(lengths, reverse=True)
    bins = P.complete_bins(lengths, 20, 100_000)
    assert sorted((x for b in bins for x in b), reverse=True) == lengths and all(sum(b) <= 20 for b in bins)
    assert len(bins) == least(tuple(lengths), ()) >= P.lower_bound(lengths, 20)
