"""Topics and subscriptions folded from a log of control events.

A control log has ``seq``, ``ts``, ``action``, ``topic`` and ``address``, in the order
``(ts, seq)``. Adding a topic, also one that exists, empties its set of subscribers; removing it
drops the set. ``initial`` names the topics registered before the first row.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicwell.functions import control as body
from topicwell.functions.endpoints import valid_endpoint
from topicwell.plans.joins import keyed_join
from topicwell.plans.running import Cells, Scan, count_before, cut, following, previous, running
from topicwell.schemas import (
    ADD_TOPIC,
    CONTROL_ORDER,
    OPEN_END,
    REMOVE_TOPIC,
    SUBSCRIBE,
    UNSUBSCRIBE,
)
from topicwell.session import literal_rows, settle, settle_with

SUCCESS, REFUSED, EXCEPTION = "Success", "error", "exception"
# Addresses in one row of a subscriber list; a longer list has several pages.
PAGE_ROWS = 10_000

def _topic_action() -> Column:
    return F.col("action").isin(ADD_TOPIC, REMOVE_TOPIC)


def _client_action() -> Column:
    return F.col("action").isin(SUBSCRIBE, UNSUBSCRIBE)


def _registered(initial: Sequence[str]) -> Column:
    """Whether the topic is registered, from the last topic action before the row."""
    at_start = F.coalesce(F.col("topic").isin(list(initial)), F.lit(False)) if initial else F.lit(False)
    return F.coalesce(F.col("_last_action") == ADD_TOPIC, at_start)


def _last_action() -> Scan:
    return previous("_last_action", F.when(_topic_action(), F.col("action")), CONTROL_ORDER)


def control_responses(control: DataFrame, initial: Sequence[str]) -> DataFrame:
    """The answer to each client action: ``Success``, ``error`` or ``exception``.

    An action succeeds if the address is a valid endpoint and the topic is registered at that
    time; also the removal of an address that is not subscribed. A log from ``parse_control``
    carries ``parse_status``; without it every row counts as decoded.
    """
    status = F.col("parse_status") if "parse_status" in control.columns else F.lit(body.OK)
    rows = control.withColumn("parse_status", status)
    known = running(rows, ["topic"], CONTROL_ORDER, [_last_action()])
    valid = valid_endpoint(F.col("address"))
    state = F.col("parse_status")
    response = (
        F.when(~_client_action() | F.col("action").isNull(), EXCEPTION)
        .when(state.isin(body.UNDECODABLE, body.ADDRESS_NOT_TEXT), EXCEPTION)
        .when(valid & (state == body.TOPIC_NOT_A_KEY), EXCEPTION)
        .when(valid & (state == body.OK) & _registered(initial), SUCCESS)
        .otherwise(REFUSED)
    )
    asked = known.where(F.col("action").isNull() | ~_topic_action())
    return asked.select("seq", "ts", "action", "topic", "address", response.alias("response"))


def last_topic_actions(control: DataFrame) -> DataFrame:
    """The last action of every topic, whole rows: all that later answers need of earlier ones."""
    actions = control.where(_topic_action()).withColumn("_row", F.struct(*control.columns))
    last = actions.groupBy("topic").agg(F.max_by("_row", F.struct(*CONTROL_ORDER)).alias("_row"))
    return last.select("_row.*")


def _initial_topics(control: DataFrame, initial: Sequence[str]) -> DataFrame:
    return literal_rows(control.sparkSession, "topic", sorted(set(initial)))


def topics_current(control: DataFrame, initial: Sequence[str]) -> DataFrame:
    """The topics registered at the end of the log."""
    last = (
        control.where(_topic_action())
        .groupBy("topic")
        .agg(F.max_by("action", F.struct(*CONTROL_ORDER)).alias("action"), F.lit(1).alias("at"))
    )
    start = _initial_topics(control, initial).select("topic", F.lit(ADD_TOPIC).alias("action"), F.lit(0).alias("at"))
    folded = last.unionByName(start).groupBy("topic").agg(F.max_by("action", "at").alias("action"))
    return folded.where(F.col("action") == ADD_TOPIC).select("topic")


def topic_count(control: DataFrame, initial: Sequence[str]) -> DataFrame:
    return topics_current(control, initial).agg(F.count(F.lit(1)).alias("n_topics"))


def has_topic(control: DataFrame, initial: Sequence[str], requests: DataFrame) -> DataFrame:
    """Add ``registered`` to the rows of ``requests``, by their ``topic``."""
    topics = settle(topics_current(control, initial).withColumn("_known", F.lit(True)))
    known = keyed_join(requests, topics, ["topic"], "left", requests.columns)
    return known.select(*requests.columns, F.coalesce("_known", F.lit(False)).alias("registered"))


def subscription_intervals(
    control: DataFrame, initial: Sequence[str], additive: bool = False, check_endpoint: bool = True
) -> DataFrame:
    """Who is subscribed when: ``topic``, ``address``, ``valid_from``, ``valid_to`` (exclusive).

    An interval runs from an accepted subscribe to the next accepted action of the same address
    or to the next reset of the topic. A reset is any topic action, or with ``additive`` only a
    removal. An open interval ends at 9999-01-01.
    """
    valid = valid_endpoint(F.col("address")) if check_endpoint else F.lit(True)
    if "parse_status" in control.columns:
        valid = valid & (F.col("parse_status") == body.OK)
    relevant = control.where(_topic_action() | (_client_action() & valid))
    reset = F.col("action") == REMOVE_TOPIC if additive else _topic_action()
    scans = [_last_action(), following("_reset", F.when(reset, F.col("ts")), CONTROL_ORDER)]
    by_topic = cut(relevant, ["topic"], CONTROL_ORDER)
    judged = running(relevant, ["topic"], CONTROL_ORDER, scans, by_topic)
    accepted = judged.where(_client_action() & _registered(initial))
    # Where no topic is too large, no address within one is. Otherwise the cells are cut on the
    # log itself, which holds every accepted row.
    own = Cells(("topic", "address"), CONTROL_ORDER)
    if by_topic.levels:
        own = cut(relevant.where(_client_action()), own.keys, own.order)
    ended = running(
        accepted, ["topic", "address"], CONTROL_ORDER, [following("_next", F.col("ts"), CONTROL_ORDER)], own
    )
    forever = F.lit(OPEN_END).cast("timestamp_ntz")
    return ended.where(F.col("action") == SUBSCRIBE).select(
        "topic",
        "address",
        F.col("ts").alias("valid_from"),
        F.least(F.col("_next"), F.col("_reset"), forever).alias("valid_to"),
    )


def control_state(control: DataFrame, initial: Sequence[str] = ()) -> DataFrame:
    """The last action of every topic (``address`` null) and of every valid (topic, address).

    Plain aggregates, so parts of a log can be folded apart and their states folded again.
    """
    relevant = control.where(_topic_action() | (_client_action() & valid_endpoint(F.col("address"))))
    if "parse_status" in control.columns:
        relevant = relevant.where(_topic_action() | (F.col("parse_status") == body.OK))
    keyed = relevant.withColumn("address", F.when(_client_action(), F.col("address")))
    return latest(keyed)


def latest(states: DataFrame) -> DataFrame:
    """The last ``action`` of each (topic, address) with its place in the log."""
    last = states.groupBy("topic", "address").agg(F.max(F.struct(*CONTROL_ORDER, "action")).alias("_last"))
    return last.select("topic", "address", "_last.*")


def subscribers_of_state(state: DataFrame, initial: Sequence[str]) -> DataFrame:
    """Subscribers from ``control_state``: subscribed after the last action of a registered topic."""
    own = state.where(F.col("address").isNotNull() & (F.col("action") == SUBSCRIBE))
    topics = state.where(F.col("address").isNull()).select(
        "topic", F.col("action").alias("_last_action"), F.col("ts").alias("_ts"), F.col("seq").alias("_seq")
    )
    joined = keyed_join(own, settle(topics), ["topic"], "left", ["address"])
    later = F.struct("ts", "seq") > F.struct(F.col("_ts").alias("ts"), F.col("_seq").alias("seq"))
    member = _registered(initial) & (F.col("_ts").isNull() | later)
    return joined.where(member).select("topic", "address")


def subscribers_current(control: DataFrame, initial: Sequence[str]) -> DataFrame:
    """The subscribers at the end of the log, without folding its history."""
    return subscribers_of_state(control_state(control), initial)


def subscriber_lists(
    control: DataFrame, initial: Sequence[str], asked: DataFrame | None = None, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """The subscribers of each topic as sorted arrays, empty for a topic without any.

    ``asked`` names further topics, which get an empty list when they are not registered. A list
    of more than ``page_rows`` addresses comes as pages 0, 1, 2, ...: put together in this order
    they are the sorted list. ``n`` is the size of the page, ``n_total`` that of the list, and
    ``n_pages`` tells when the list is complete. A list without addresses has one empty page.
    """
    ends = {"first": F.min("address"), "last": F.max("address")}
    members, seen = settle_with(subscribers_current(control, initial), **ends)
    shared = len(commonprefix([seen["first"] or "", seen["last"] or ""]))
    # Large lists are cut by the bytes after the prefix that all addresses share.
    rest = F.expr(f"substring(address, {shared + 1})").cast("binary")
    for place, name in enumerate(("_head", "_next")):
        digits = F.rpad(F.hex(F.substring(rest, 7 * place + 1, 7)), 14, "0")
        members = members.withColumn(name, F.conv(digits, 16, 10).cast("bigint"))
    paged = running(members, ["topic"], ["_head", "_next", "address"], [count_before("_before")])
    pages = (
        paged.withColumn("page", F.call_function("div", F.col("_before"), F.lit(page_rows)))
        .groupBy("topic", "page")
        .agg(F.array_sort(F.collect_list("address")).alias("addresses"))
        .select("topic", "page", F.size("addresses").cast("bigint").alias("n"), "addresses")
    )
    totals = settle(members.groupBy("topic").agg(F.count(F.lit(1)).alias("n_total")))
    pages = keyed_join(pages, totals, ["topic"], "inner", ["page"])
    pages = pages.withColumn("n_pages", F.ceil(F.col("n_total") / page_rows).cast("bigint"))
    topics = topics_current(control, initial)
    if asked is not None:
        topics = topics.unionByName(asked.select("topic")).distinct()
    # Members are in registered topics only. The empty lists are added rather than joined, so the
    # pages of a large topic do not meet in one task.
    empty = topics.join(members.select("topic").distinct(), "topic", "left_anti").select(
        "topic",
        F.lit(0).cast("bigint").alias("page"),
        F.lit(0).cast("bigint").alias("n"),
        F.array().cast("array<string>").alias("addresses"),
        F.lit(0).cast("bigint").alias("n_total"),
        F.lit(1).cast("bigint").alias("n_pages"),
    )
    return pages.unionByName(empty)


def connect_sessions(log: DataFrame, additive: bool = False) -> DataFrame:
    """Viewing intervals from a log of ``connect`` and ``disconnect`` rows.

    A connect registers the topic and subscribes the viewer, so it resets the earlier viewers of
    the topic; with ``additive`` they stay. The viewer is in ``address``.
    """
    connect = F.array(F.lit(ADD_TOPIC), F.lit(SUBSCRIBE))
    actions = F.when(F.col("action") == "connect", connect).otherwise(F.array(F.lit(UNSUBSCRIBE)))
    steps = log.where(F.col("action").isin("connect", "disconnect")).select(
        "ts", "topic", "address", F.col("seq").alias("_log_seq"), F.posexplode(actions).alias("_step", "action")
    )
    control = steps.select(
        (F.col("_log_seq") * 2 + F.col("_step")).alias("seq"),
        "ts",
        "action",
        "topic",
        F.when(F.col("action") != ADD_TOPIC, F.col("address")).alias("address"),
    )
    return subscription_intervals(control, [], additive, check_endpoint=False)
