"""Registered queries of the llm operators over the given tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell.llm.chat_format import format_turns, read_loss, read_turns
from topicwell.llm.embedding_dedup import embedding_links
from topicwell.llm.exact_dedup import exact_groups
from topicwell.llm.language_id import identify_languages
from topicwell.llm.line_dedup import line_dedup
from topicwell.llm.mixing import mix_sources
from topicwell.llm.ngram_join import ngram_links
from topicwell.llm.packing import pack_documents
from topicwell.llm.quality import score_quality
from topicwell.llm.ranked_search import ranked_search
from topicwell.llm.substring_dedup import factor_dedup
from topicwell.llm.suffix_dedup import suffix_dedup
from topicwell.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_fold(of: int, remainder: int) -> Column:
    """Whether the checksum of the document's id as text has the remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_read(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"), in_fold(4, 2))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factor_dedup(_read(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def _digest_turns(batches):
    """Turns and loss text, read back from the formatted conversations."""
    for batch in batches:
        turns, loss, n_turns, n_loss = [], [], [], []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            read = read_turns(formatted)
            turns.append(hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in read).encode()).hexdigest())
            learned = read_loss(formatted, spans)
            loss.append(hashlib.sha256(learned.encode()).hexdigest())
            n_turns.append(len(read))
            n_loss.append(len(learned))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_turns, pa.int64()),
                pa.array(turns, pa.string()),
                pa.array(n_loss, pa.int64()),
                pa.array(loss, pa.string()),
                batch.column(3),
            ],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    out = format_turns(turns.unionByName(probe))
    read = out.select("conv_id", "formatted", "loss_spans", F.char_length("formatted").cast("bigint").alias("n"))
    kind = dict(turns.dtypes)["conv_id"]
    return read.mapInArrow(
        _digest_turns,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), in_fold(3, 1))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_source_mixing": op7_source_mixing,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_NORMAL = _LOWER.format("coalesce(text, '')")
_ESCAPED = (
    r"regexp_replace({}, '([<\[])(\\*(?:/?s>|\|[a-z_]+(?::[0-9]+)?\|>|/?INST\]|/?SYS>>))', '\1\\\2', 'g')"
)

ORACLE: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        ), u AS (
            SELECT vec_id, x FROM v
            WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(x, lambda c: c <> 0)) > 0
        ), link AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.9 ELSE false END
        ), reach AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a
        ), n AS (
            SELECT a, count(*) AS n_links FROM link GROUP BY a
        ), least AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
        FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a""",
    "op3_exact_dedup": f"""
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY n) AS keep_id,
               count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY n) AS kept,
               sha256(n) AS text_sha256
        FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)""",
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p
        ), hit AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE f < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
        ), kept AS (
            SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS k, count(*) AS n
            FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_chat_format": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), f AS (
            SELECT *, '<|turn|>' || {_ESCAPED.format("role")} || '<|body|>' || {_ESCAPED.format("text")} || '<|end|>' AS formatted,
                   CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               length(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_chars,
               sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
               length(string_agg(formatted, '' ORDER BY turn, role, text)) AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op9_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS h
            FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)
        ), hit AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
            FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)
        ), run AS (
            SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit
        ), span AS (
            SELECT doc_id, min(i) AS s, max(i) + 199 AS e FROM run GROUP BY doc_id, r
        ), edge AS (
            SELECT doc_id, s, e FROM span UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM d
        ), piece AS (
            SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM edge
        )
        SELECT d.doc_id, any_value(octet_length(b))::BIGINT AS n_bytes,
               coalesce(sum(e - s + 1), 0)::BIGINT AS n_removed, count(e) AS n_spans,
               sha256(unhex(string_agg(hex(array_slice(b, before + 1, s - 1)), '' ORDER BY s))) AS kept_sha256
        FROM d JOIN piece USING (doc_id) GROUP BY d.doc_id""",
    "op11_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
        ), k AS (
            SELECT doc_id, line, i, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM l
        ), often AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, line, i, coalesce(doc_id < keeper, false) AS gone FROM k LEFT JOIN often USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op12_ranked_search": f"""
        WITH d AS (
            SELECT doc_id, {_TERMS} AS t FROM documents
        ), s AS (
            SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0
        ), whole AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM s
        ), tf AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM s) GROUP BY doc_id, n, term
        ), df AS (
            SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
        ), q AS (
            SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
        ), scored AS (
            SELECT item_id, doc_id,
                   sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms)))))::BIGINT AS score
            FROM q JOIN df USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
            FROM scored WHERE score > 0
        ) WHERE rank <= 20""",
}
