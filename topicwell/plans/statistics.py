"""What is known of a table before a job runs: bounds from Parquet footers and file sizes.

A counting pass over the data is worth it only where something may be too large. The footers of the files
hold their rows, and a plan of filters, projections, sorts, windows, aggregates, unions and semi or anti joins
never has more rows than its files together. Only few and small files are looked at: beyond that the bound
would be above every limit anyway, and the caller counts.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# Files of one table whose footers the driver reads, and their bytes.
FOOTERS = 64
FOOTER_BYTES = 4 * 1024 * 1024 * 1024
# Bytes on disk of a table that one task reads at once.
ONE_TASK_BYTES = 8 * 1024 * 1024

# Plan nodes that do not make rows.
_KEEPS = {
    "Project", "Filter", "SubqueryAlias", "Aggregate", "Distinct", "Deduplicate", "Window", "WindowGroupLimit", "Sort",
    "Repartition", "RepartitionByExpression", "RebalancePartitions", "Union", "GlobalLimit", "LocalLimit", "ResolvedHint",
}
_FILTERS = {"LeftSemi", "LeftAnti"}

# Rows of files by path, length and time of change.
_footers: dict[tuple[str, int, int], int] = {}


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _leaves(node: JavaObject) -> list[JavaObject] | None:
    """The leaves of a plan, or None if something in it may make rows."""
    kind = _name(node)
    if kind in ("LogicalRelation", "LocalRelation"):
        return [node]
    if kind not in _KEEPS and not (kind == "Join" and node.joinType().toString() in _FILTERS):
        return None
    found: list[JavaObject] = []
    children = node.children()
    for i in range(children.size()):
        below = _leaves(children.apply(i))
        if below is None:
            return None
        found += below
    return found


def _rows_of_file(spark: SparkSession, path: JavaObject) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    status = path.getFileSystem(conf).getFileStatus(path)
    key = (status.getPath().toString(), status.getLen(), status.getModificationTime())
    if key not in _footers:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf)
        )
        try:
            _footers[key] = reader.getRecordCount()
        finally:
            reader.close()
    return _footers[key]


def _relation(leaf: JavaObject) -> JavaObject | None:
    """The Parquet files of a leaf."""
    relation = leaf.relation()
    if _name(relation) != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return None
    return relation


def most_rows(df: DataFrame) -> int | None:
    """Rows that ``df`` has at most, or None if that is not known without a job."""
    leaves = _leaves(df._jdf.queryExecution().optimizedPlan())
    if leaves is None:
        return None
    spark = df.sparkSession
    rows = 0
    for leaf in leaves:
        if _name(leaf) == "LocalRelation":
            rows += leaf.data().size()
            continue
        relation = _relation(leaf)
        if relation is None or relation.location().sizeInBytes() > FOOTER_BYTES:
            return None
        files = relation.location().inputFiles()
        if len(files) > FOOTERS:
            return None
        for file in files:
            rows += _rows_of_file(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)))
    return rows


def one_task(df: DataFrame) -> bool:
    """Whether the files of a table read as written are so small that one task reads them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    relation = _relation(plan) if _name(plan) == "LogicalRelation" else None
    return relation is not None and relation.location().sizeInBytes() <= ONE_TASK_BYTES
