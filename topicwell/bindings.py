"""The driver's ``events`` table seen as ticks, control log, read requests and queue operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwell.operators.replay import Grid
from topicwell.schemas import ADD_TOPIC, REMOVE_TOPIC, SUBSCRIBE, UNSUBSCRIBE
from topicwell.session import literal_rows

# The registered topics, in this order, and the seconds of a replay slot.
TOPICS = ["click", "purchase", "view"]
SLOT_SECONDS = 3600


def grid(events: DataFrame) -> Grid:
    """The hours from the first to the last event."""
    return Grid.covering(TOPICS, events, SLOT_SECONDS)


def number() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", number())


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_of(events(spark, sf_dir))


def tagged_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topic", F.col("event_type"))


def topics(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "topic", TOPICS)


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_of(events(spark, sf_dir))


def control_of(rows: DataFrame) -> DataFrame:
    """signup and error rows subscribe and unsubscribe; some view rows add and remove topics."""
    kind, k = F.col("event_type"), F.col("k")
    user = (F.col("user_id") % 10).cast("string")
    address = F.concat(F.lit("grpc://u"), user, F.lit(":"), (F.col("user_id") % 10 * 8000).cast("string"))
    client = kind.isin("signup", "error")
    return (
        rows.where(client | ((kind == "view") & k.isin(0, 1)))
        .select(
            F.col("event_id").alias("seq"),
            "ts",
            F.when(kind == "signup", SUBSCRIBE)
            .when(kind == "error", UNSUBSCRIBE)
            .when(k == 0, ADD_TOPIC)
            .otherwise(REMOVE_TOPIC)
            .alias("action"),
            F.when(client, pick([*TOPICS, "bogus"], k % 4)).otherwise(pick(TOPICS, F.col("user_id") % 3)).alias("topic"),
            F.when(client, address).alias("address"),
        )
    )


def control_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client rows of the control log with their JSON text instead of the columns."""
    text = F.to_json(F.struct("address", "topic"))
    client = control(spark, sf_dir).where(F.col("address").isNotNull())
    return client.select("seq", "ts", "action", text.alias("body"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        events(spark, sf_dir)
        .where(kind.isin("signup", "error"))
        .select(
            F.col("event_id").alias("seq"),
            "ts",
            F.when(kind == "signup", "connect").otherwise("disconnect").alias("action"),
            pick(TOPICS, F.col("k") % 3).alias("topic"),
            F.col("user_id").cast("string").alias("address"),
        )
    )


def queue_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        events(spark, sf_dir)
        .where(kind.isin("click", "view"))
        .select(
            F.col("event_id").alias("seq"),
            "ts",
            F.when(kind == "click", "write").otherwise("read").alias("op"),
            F.length("props").alias("size"),
        )
    )


def requests(committed: DataFrame) -> DataFrame:
    """Eight read requests per topic around the ends of its log, and eight for an unknown topic."""
    spark = committed.sparkSession
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*TOPICS, "bogus"])], "place int, topic string")
    ends = asked.join(committed, "topic", "left")
    c = F.coalesce("committed", F.lit(0))
    offsets = F.array(F.lit(0), F.lit(4), c - 101, c - 100, c - 1, c, c + 5, F.lit(-1))
    each = ends.select("place", "topic", F.posexplode(offsets).alias("i", "offset"))
    request = (F.col("place") * 8 + F.col("i")).cast("bigint")
    return each.select(request.alias("request_id"), "topic", F.col("offset").cast("bigint").alias("offset"))


def tick_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as text with some values that break each rule."""
    k = F.col("k")
    bid = F.col("value").cast("decimal(10,2)")
    step = (k.cast("decimal(10,2)") / 100).cast("decimal(10,2)")
    return events(spark, sf_dir).select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(k == 0, F.concat("event_type", F.lit("_overlong"))).otherwise(F.col("event_type")).alias("stock_symbol"),
        F.when(k == 1, None).when(k == 3, "1000000000").otherwise(F.col("value").cast("string")).alias("price"),
        F.when(k == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("volume"),
        bid.cast("string").alias("bid_price"),
        (bid + step).cast("string").alias("ask_price"),
        step.cast("string").alias("spread"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one well-formed tick."""
    money = "decimal(10,2)"
    bid = F.col("value").cast(money)
    step = (F.col("k").cast(money) / 100).cast(money)
    return events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("stock_symbol"),
        bid.alias("price"),
        F.col("k").alias("volume"),
        bid.alias("bid_price"),
        (bid + step).cast(money).alias("ask_price"),
        step.alias("spread"),
    )
