"""Relational databases through Spark's JDBC source.

The reference picks SQLite, MySQL or PostgreSQL by configuration. Spark
reads any of them with the JDBC source; a numeric ``partition_column`` with
bounds splits the read into ``num_partitions`` parallel range queries (one
connection each), and ``fetchsize`` / ``batchsize`` size the round trips.
The driver jar must be on the classpath; nothing here starts a database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URL_PREFIX = {"sqlite": "jdbc:sqlite:", "mysql": "jdbc:mysql://", "postgresql": "jdbc:postgresql://"}


def jdbc_url(dialect: str, target: str) -> str:
    """``target`` is a file path for sqlite, ``host:port/db`` otherwise."""
    if dialect not in URL_PREFIX:
        raise ValueError(f"unsupported database type: {dialect!r}")
    return URL_PREFIX[dialect] + target


def read_table(spark: SparkSession, url: str, table: str, *, properties: dict | None = None,
               partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
               num_partitions: int | None = None, fetchsize: int = 10_000) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetchsize)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("a partitioned JDBC read needs lower, upper and num_partitions")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, *, properties: dict | None = None, mode: str = "append",
                batchsize: int = 10_000, num_partitions: int | None = None) -> None:
    """Write with at most ``num_partitions`` concurrent connections."""
    if num_partitions:
        df = df.coalesce(num_partitions)
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in (properties or {}).items():
        writer = writer.option(k, v)
    writer.mode(mode).save()
