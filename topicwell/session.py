"""Session settings, size limits and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicwell.plans.statistics import most_rows, one_task

# Rows one window task or one join key may hold before the group is split.
GROUP_ROWS = 1_000_000
# Rows and bytes of a table that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 * 1024 * 1024


def build_session(app: str = "topicwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; a cluster sets the rest itself."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.topicwell.groupRows", str(GROUP_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.topicwell.broadcastRows", str(BROADCAST_ROWS)))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.topicwell.broadcastBytes", str(BROADCAST_BYTES)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may go without it; it then gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="topicwell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


# The folder that intermediate tables go to while a scope is open.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used.

    The paths of an application lie in one folder, which may be deleted when the application has ended;
    those made inside a ``scratch_scope`` go when it ends.
    """
    folder = _scope.get() or f"{shared_dir(spark)}/topicwell-{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one piece of work, deleted at its end.

    Nothing that reads these tables may be used afterwards. Work that is repeated takes a folder of its own.
    """
    folder = fresh_path(spark, "scope")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def literal_rows(spark: SparkSession, column: str, values: Sequence[str]) -> DataFrame:
    """A short list of texts as a table whose rows are literals of the plan."""
    names = {f"v{i}": v for i, v in enumerate(values)}
    rows = ", ".join(f"(:{n})" for n in names) or "(CAST(NULL AS STRING))"
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t({column})", args=names or None)
    return table if names else table.where(F.lit(False))


def _rows_in_plan(df: DataFrame) -> int | None:
    """The number of rows if they are literals of the plan, which every task is sent anyway."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.data().size() if plan.getClass().getSimpleName() == "LocalRelation" else None


# Types whose values differ in size, or take more than eight bytes.
_VARYING = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.DecimalType, T.VariantType)

# Rows and bytes of tables that have been counted.
_sizes: WeakKeyDictionary[DataFrame, tuple[int, int]] = WeakKeyDictionary()


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(8 * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return size.cast("bigint")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there."""
    return df if _rows_in_plan(df) is not None else settle_table(df, "settled")


def settle_with(df: DataFrame, **facts: Column) -> tuple[DataFrame, Row]:
    """As ``settle``, with aggregates of the written table. Its size is one of them and kept for later checks."""
    table = settle_table(df, "settled")
    # A small table is measured by one task, without a shuffle.
    read = table.coalesce(1) if one_task(table) else table
    measured = {"held_rows": F.count(F.lit(1)), "bytes": F.coalesce(F.sum(_row_bytes(table)), F.lit(0)), **facts}
    found = read.agg(*[c.alias(n) for n, c in measured.items()]).first()
    _sizes[table] = (found["held_rows"], found["bytes"])
    return table, found


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table that grows with the data to the shared folder, by columns, and read it from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(spark: SparkSession, rows: int, size: int) -> bool:
    """Whether a table of so many rows and bytes may be broadcast."""
    return rows <= broadcast_rows(spark) and size <= broadcast_bytes(spark)


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes: known for literal rows and settled tables, else counted by reading the table once.

    Rows of numbers and times only are not counted if the footers of their files hold few enough.
    """
    held = _rows_in_plan(df)
    if held is not None:
        return held, 0
    if df not in _sizes and not any(isinstance(f.dataType, _VARYING) for f in df.schema):
        most = most_rows(df)
        if most is not None and fits(df.sparkSession, most, 8 * most * len(df.columns)):
            _sizes[df] = (most, 8 * most * len(df.columns))
    if df not in _sizes:
        found = df.agg(F.count(F.lit(1)).alias("held"), F.sum(_row_bytes(df)).alias("bytes")).first()
        _sizes[df] = (found.held, found.bytes or 0)
    return _sizes[df]


def broadcastable(df: DataFrame) -> bool:
    """Whether a table is small enough, in rows and in bytes, to be sent to every executor."""
    return fits(df.sparkSession, *table_size(df))
