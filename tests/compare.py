"""Comparison of a Spark result with the SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
from contextlib import contextmanager
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None if column names and rows agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    wanted = _rows(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if found == wanted:
        return None
    only_spark = [r for r in found if r not in set(wanted)][:3]
    only_sql = [r for r in wanted if r not in set(found)][:3]
    return f"{len(found)} rows against {len(wanted)}; only Spark {only_spark}; only SQL {only_sql}"


@contextmanager
def limits(spark, group_rows, broadcast_rows):
    """Row limits of the session for the length of a block."""
    names = {"spark.topicwell.groupRows": group_rows, "spark.topicwell.broadcastRows": broadcast_rows}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)
