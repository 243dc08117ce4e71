"""A corpus pipeline: language filter, exact and near duplicates, mixing and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and hands it, reread, to the next stage. All stages but the last return
the columns of ``documents``, extra ones included. Rows are told apart by id, file and place in the
file, so rows that share or lack an id are decided one by one.

1. ``language``: documents whose language cannot be told (no letter, or two languages about as
   likely) go. Languages are learned from the rows outside the held-out fold.
2. ``exact``: of equal texts one row with the largest id stays.
3. ``near``: one document of each group of similar ones stays, the one with the smallest id.
4. ``mix``: the mix takes blocks of words, some of them twice. The first copy of a document has its words that
   are taken at least once, the second those taken twice; a copy of all words is the text as it is. Documents
   that the mix leaves out go.
5. ``pack``: the mixed documents in sequences of at most 1024 tokens.

Null and empty texts go in the first stage; an empty table passes through all stages.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicwell.llm.catalog import in_fold  # noqa: E402
from topicwell.llm.exact_dedup import exact_groups  # noqa: E402
from topicwell.llm.language_id import UND, identify_languages  # noqa: E402
from topicwell.llm.mixing import mix_sources  # noqa: E402
from topicwell.llm.ngram_join import ngram_links  # noqa: E402
from topicwell.llm.packing import pack_documents  # noqa: E402
from topicwell.llm.tables import having, settle, small  # noqa: E402

# A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

# A source's documents are dealt alike if one in so many, or fewer, is an exception.
FEW = 16


def _free(columns: Sequence[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to be none of ``columns``, nor be one with a ``_k_``."""
    taken = {c.lower() for c in columns}
    front = "_"
    while taken & {f"{key}{front}{n}" for key in ("", "_k_") for n in names}:
        front += "_"
    return [front + n for n in names]


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of id, file and place in the file, and its name. A table that is no file scan is written first."""
    (row,) = _free(docs.columns, "row")

    def with_place(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", F.struct("doc_id", F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(row))

    try:
        return with_place(docs), row
    except AnalysisException:
        return with_place(settle(docs, "documents")), row


def _staying(docs: DataFrame, row: str, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (the row and ``kept``) keeps."""
    kept = settle(decided.where("kept").select(row), "kept")
    return having(docs, kept).drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _placed(docs)
    found = identify_languages(docs, in_fold(4, 2), id_col=row)
    return _staying(docs, row, found.withColumn("kept", (F.col("lang_pred") != UND) & ~F.col("ambiguous")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _placed(docs)
    return _staying(docs, row, exact_groups(docs, id_col=row))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _placed(docs)
    return _staying(docs, row, ngram_links(docs, id_col=row))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the copies of documents. Only texts of sources whose documents are taken in many ways meet their row in a shuffle.

    A source at its limit has nearly all its documents taken whole and equally often (``usual``): these are dealt by
    a row of the source, the others of it by a broadcast list.
    """
    columns = docs.columns
    docs, row = _placed(docs)
    names = _free(docs.columns, "mixed", "origin", "least", "most", "ranges", "usual", "words", "copy")
    mixed, origin, least, most, ranges, usual, words, copy = names
    times = F.transform("ranges", lambda r: r["times"])
    fewest, often = (F.coalesce(f(times), F.lit(0).cast("bigint")) for f in (F.array_min, F.array_max))
    taken = mix_sources(docs, id_col=row, hash_col="doc_id", ranges=True)
    taken = taken.select(row, "source", fewest, often, F.when(fewest < often, F.col("ranges"))).toDF(*names[:5])
    taken = settle(taken, "mixed")

    # Documents that are not dealt by their source's row are listed.
    def listed(alike: DataFrame) -> DataFrame:
        found = taken.join(F.broadcast(alike.toDF("_alike", usual)), F.col(origin).eqNullSafe(F.col("_alike")), "left")
        as_usual = (F.col(least) == F.col(most)) & (F.col(most) == F.coalesce(usual, F.lit(0)))
        return found.where(~as_usual).select(mixed, least, most, ranges, usual)

    equally = F.when(F.col(least) == F.col(most), F.col(most)).alias(usual)
    counts = taken.groupBy(origin, equally).agg(F.count(F.lit(1)).alias("n"))
    whole = F.when(F.col(usual).isNotNull(), F.col("n"))
    sources = counts.groupBy(origin).agg(F.max_by(usual, whole).alias(usual), F.max(whole).alias("n"), F.sum("n").alias("all"))
    few = (F.col("all") - F.col("n")) * FEW <= F.col("all")
    alike = settle(sources.where((F.col(usual) > 0) & few).select(origin, usual), "alike")
    if not small(alike) or not small(listed(alike).where(F.col(usual).isNotNull())):
        alike = alike.where(F.lit(False))
    listing = settle(listed(alike), "listed")

    dealt = docs.join(F.broadcast(alike), F.col("source").cast("string").eqNullSafe(F.col(origin)), "left").drop(origin)
    match = F.col(row).eqNullSafe(F.col(mixed))
    if small(listing):
        chosen = dealt.join(F.broadcast(listing.drop(usual)), match, "left")
    else:
        by_source, one_by_one = F.col(usual).isNotNull(), F.col(usual).isNull()
        chosen = dealt.where(by_source).join(F.broadcast(listing.where(by_source).drop(usual)), match, "left")
        chosen = chosen.unionByName(dealt.where(one_by_one).join(listing.where(one_by_one).drop(usual), match))
    unlisted = F.col(mixed).isNull()
    for name in (least, most):
        chosen = chosen.withColumn(name, F.when(unlisted, F.coalesce(usual, F.lit(0).cast("bigint"))).otherwise(F.col(name)))
    chosen = chosen.where(F.col(most) > 0)

    spaced = F.when(F.col(least) < F.col(most), F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)))
    copies = chosen.withColumn(words, spaced).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), most)))
    held = F.filter(ranges, lambda r: r["times"] >= F.col(copy))
    runs = F.transform(held, lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["words"].cast("int")))
    is_whole = F.col(copy) <= F.col(least)
    cut = copies.withColumn("text", F.when(is_whole, F.col("text")).otherwise(F.array_join(F.flatten(runs), "")))
    if "n_chars" in columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(is_whole, F.col("n_chars")).otherwise(length))
    return cut.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# The first, third and last stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
