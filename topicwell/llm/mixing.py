"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

1. *Targets.* Sources in code-point order, null last, take the weights in turn and share ``share``
   times all words. No target passes ``repeats`` times its source; what is cut off is shared again
   by weight among the others until no target is above.
2. *Quotas.* The words to take make blocks of ``block`` words. Blocks go one by one to the highest
   quotient ``target / (2 k + 1)`` of a source that has ``k`` blocks so far. The quotas of all but
   a few blocks follow from two divisors between which the final one lies; only the quotients
   between them, at most three per source, are ranked. A source's blocks are apportioned to its
   shards in the same way by their words.
3. *Blocks.* A shard holds about ``shard_rows`` documents, by hash of the id, and lines up their
   words in seeded order. Rows of an id that many share, or that have none, are dealt one by one (``_spread``). Each of its blocks is taken ``quota div blocks`` times, and the first
   ``quota mod blocks`` in another seeded order once more. A document's take is the sum over the
   blocks that it crosses, so no document passes ``repeats`` times its size.

A source is divided into shards that do not grow with it, so a source with a third of all rows is
spread like any other. Sources and shards are tables; the driver sees totals only. A source's
quotas are off by less than a block per shard, and by the last, partly filled block of a shard.

Defined cases: null text has no words; null ids are an id that rows share; repeated rows are rows of
their own and equal rows are ordered as they come; a source without words gets nothing; an empty
table gives an empty result; columns beside id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicwell.llm.tables import having, numbered, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 128
SHARD_ROWS = 4_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """Add ``target`` to a settled table of ``source, source_size``."""
    place = numbered(sources.withColumn("_null", F.col("source").isNull().cast("int")), [F.col("_null"), F.col("source")], "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(
        place.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("_place") % len(weights) + 1).cast("int")).alias("weight"),
            (F.lit(repeats) * F.col("source_size")).cast("double").alias("most"),
        ),
        "weights",
    )
    whole = table.agg(F.sum("source_size")).first()[0]
    if not whole:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    total = share * whole
    # A source is full from the water level most / weight on. Raising the level only adds full ones.
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level)
        held = table.agg(
            F.sum(F.when(full, F.col("most"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not held.weight:
            return table.select("source", "source_size", F.col("most").alias("target"))
        raised = (total - (held.full or 0.0)) / held.weight
        if level is not None and raised <= level:
            break
        level = raised
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _apportioned(votes: DataFrame, within: Sequence[str], tie: Column) -> DataFrame:
    """Seats by highest quotients ``votes / (2 k + 1)``, ``most`` seats at most, in each group.

    ``votes`` has ``votes`` (double), ``most`` and the group's ``seats``, ``all_votes`` and
    ``members``. The final divisor lies between those that would give ``seats`` plus and minus
    ``members``: rounding moves the total by half a seat per member.
    """
    seats, members = F.col("seats"), F.col("members")

    def rounded(divisor_seats: Column) -> Column:
        count = F.floor(F.col("votes") * divisor_seats / F.col("all_votes") + F.lit(0.5))
        return F.least(F.greatest(count, F.lit(0)).cast("bigint"), F.col("most"))

    bounded = votes.withColumn("_low", rounded(F.greatest(seats - members, F.lit(0)))).withColumn(
        "_high", rounded(seats + members)
    )

    def between(df: DataFrame) -> DataFrame:
        seat = F.explode(F.sequence(F.col("_low"), F.col("_high") - 1))
        return df.where(F.col("_high") > F.col("_low")).withColumn("_k", seat).withColumn(
            "_quotient", F.col("votes") / (2 * F.col("_k") + 1)
        )

    if within:
        group = Window.partitionBy(*within)
        sure = between(bounded.withColumn("_sure", F.sum("_low").over(group)))
        best = group.orderBy(F.desc("_quotient"), tie, F.col("_k"))
        ranked = sure.withColumn("_rank", F.row_number().over(best) - 1)
    else:
        sure = bounded.agg(F.sum("_low")).first()[0] or 0
        ranked = numbered(between(bounded), [F.desc("_quotient"), tie, F.col("_k")], "_rank")
        ranked = ranked.withColumn("_sure", F.lit(sure))
    ranked = ranked.where(F.col("_rank") < seats - F.col("_sure"))
    keys = [*within, "member"]
    won = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won")).toDF(*[f"_{k}" for k in keys], "_won")
    match = F.col("member").eqNullSafe(F.col("_member"))
    for k in within:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return bounded.join(won, match, "left").select(
        *votes.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota")
    )


def _spread(sized: DataFrame, shard_rows: int) -> DataFrame:
    """Give the rows of a hash that an eighth of a shard shares hashes of their own.

    These come from the text and a number among the rows alike in it, so that reruns agree. Rows are numbered
    within the partition they are read in, and these by the counts of the partitions before: no task holds all rows alike.
    """
    held = sized.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    hot = settle(held.where(F.col("n") > max(1, shard_rows // 8)).select("hash"), "hot")
    if hot.isEmpty():
        return sized.drop("text_hash")
    alike = F.xxhash64("hash", "text_hash", "source", "size").alias("_alike")
    rows = settle(having(sized.select("*", alike, F.spark_partition_id().alias("_part")), hot), "alike")
    counts = rows.groupBy("_alike", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_alike").orderBy("_part")) - F.col("_n")
    own = F.row_number().over(Window.partitionBy("_alike", "_part").orderBy("id"))
    numbers = rows.withColumn("_own", own).join(counts.select("_alike", "_part", earlier.alias("_before")), ["_alike", "_part"])
    dealt = numbers.withColumn("hash", F.xxhash64("_alike", F.col("_before") + F.col("_own")))
    rest = having(sized, hot, "left_anti").select("id", "hash", "source", "size")
    return settle(rest.unionByName(dealt.select(*rest.columns)), "spread")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
    hash_col: str | None = None,
    ranges: bool = False,
) -> DataFrame:
    """``id_col, size, source_size, target, taken``, one row per row of ``docs``, and ``source`` and ``ranges`` if asked for.

    Shards and seeded order go by the hash of ``hash_col``, or of the id. ``ranges`` are the runs of words that lie
    in one block, in order: ``first`` (from 0), ``words`` and the ``times`` they are taken; null without words.
    """
    sized = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(F.col(hash_col or id_col), F.lit(seed)).alias("hash"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
        ),
        "sizes",
    )
    sources = settle(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources"
    )
    targets = settle(source_targets(sources.drop("rows"), weights, share, repeats), "targets")
    shard_count = F.ceil(F.col("rows") / shard_rows).cast("bigint").alias("shards")
    _source = F.col("source").alias("_source")
    sharding = settle(sources.select(_source, shard_count), "sharding")

    def with_source(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    sharded = with_source(_spread(sized, shard_rows), sharding).select(
        "id", "hash", "source", "size", F.pmod(F.col("hash"), F.col("shards")).alias("shard")
    )
    shards = settle(sharded.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "shards")

    # Quotas of sources.
    totals = targets.agg(F.sum("target").alias("t"), F.count(F.lit(1)).alias("n")).first()
    all_votes = totals.t or 0.0
    blocks_of = F.ceil(F.col("shard_size") / block).cast("bigint")
    room = shards.groupBy(F.col("source").alias("_source")).agg(F.sum(repeats * blocks_of).alias("most"))
    votes = with_source(targets, room).select(
        F.col("source").alias("member"),
        F.col("target").alias("votes"),
        "most",
        F.lit(round(all_votes / block)).cast("bigint").alias("seats"),
        F.lit(all_votes or 1.0).alias("all_votes"),
        F.lit(totals.n).cast("bigint").alias("members"),
    )
    source_quota = settle(_apportioned(votes, [], F.col("member").asc_nulls_last()), "source-quota")

    # Quotas of shards within their source.
    by_source = shards.groupBy(_source).agg(
        F.sum("shard_size").cast("double").alias("all_votes"), F.count(F.lit(1)).alias("members")
    )
    held = source_quota.select(F.col("member").alias("_source"), F.col("quota").alias("seats"))
    shard_votes = with_source(with_source(shards, by_source), held).select(
        "source",
        F.col("shard").alias("member"),
        "shard_size",
        F.col("shard_size").cast("double").alias("votes"),
        (repeats * blocks_of).alias("most"),
        "seats",
        F.greatest(F.col("all_votes"), F.lit(1.0)).alias("all_votes"),
        "members",
    )
    quotas = settle(_apportioned(shard_votes, ["source"], F.col("member").asc()), "shard-quota")

    # Blocks of each shard in seeded order; a block is taken `times` times.
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_of - 1)).alias("block")
    full = quotas.where(F.col("shard_size") > 0).withColumn("_blocks", blocks_of)
    listed = full.select(F.col("source").alias("_source"), F.col("member").alias("_shard"), "quota", "_blocks", number)
    seeded = Window.partitionBy("_source", "_shard").orderBy(
        F.xxhash64("_source", "_shard", "block", F.lit(seed)), F.col("block")
    )
    once_more = F.row_number().over(seeded) <= F.col("quota") % F.col("_blocks")
    times = listed.select(
        "_source",
        "_shard",
        F.col("block").alias("_block"),
        (_div(F.col("quota"), F.col("_blocks")) + once_more.cast("bigint")).alias("times"),
    )

    # Where each document lies in its shard's line of words.
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("hash"), F.col("id"), F.col("size"))
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sharded.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    crossed = F.explode(
        F.when(F.col("size") > 0, F.sequence(_div(F.col("start"), block), _div(F.col("end") - 1, block))).otherwise(
            F.array(F.lit(-1).cast("bigint"))
        )
    )
    pieces = placed.withColumn("block", crossed)
    inside = F.least(F.col("end"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    match = (
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block"))
    )
    times_taken = F.coalesce("times", F.lit(0).cast("bigint"))
    taken = F.when(F.col("size") > 0, inside * times_taken).otherwise(F.lit(0))
    first = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    run = F.struct(first.alias("first"), inside.alias("words"), times_taken.alias("times"))
    # Spark takes the blocks for as small as the quotas that they are listed from, and would broadcast them.
    columns = ["source", "shard", "id", "start", "size", taken.alias("part")]
    columns += [F.when(F.col("size") > 0, run).alias("run")] if ranges else []
    joined = pieces.join(times.hint("merge"), match, "left").select(*columns)
    # Rows with words differ in their start; equal rows without words are counted.
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.count(F.lit(1)))
    sums = [F.sum("part").alias("taken"), copies.cast("bigint").alias("copies")]
    if ranges:
        runs = F.sort_array(F.collect_list("run"))
        sums.append(F.when(F.col("size") > 0, runs).alias("ranges"))
    whole = joined.groupBy("source", "shard", "id", "start", "size").agg(*sums)
    rows = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_copy")
    final = targets.select(_source, "source_size", "target")
    return with_source(rows, final).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", *(["source", "ranges"] if ranges else []))
