"""Zero-filled fixed-size bucket series.

Rows are bucketed by an integer index and aggregated; the result is
left-joined onto a generated ``0..n-1`` index so empty buckets read 0.
The index frame has a fixed, tiny size (n rows), so the join is a broadcast
of a bounded side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zero_filled(spark: SparkSession, per_bucket: DataFrame, bucket_col: str, n: int,
                value_cols: dict[str, object]) -> DataFrame:
    """``per_bucket`` (one row per bucket index) expanded to all ``0..n-1`` indexes.

    ``value_cols`` maps column -> fill value for buckets that have no rows.
    """
    index = spark.range(n).select(F.col("id").cast("int").alias(bucket_col))
    # per_bucket has at most n rows (one per index), so broadcasting it is bounded
    out = index.join(F.broadcast(per_bucket), on=bucket_col, how="left")
    return out.fillna(value_cols).select(bucket_col, *value_cols.keys())


def bucket_index(n: int, age: Column) -> Column:
    """Reference layout: index ``n-1`` is the newest bucket; ages outside ``[0, n)`` get null."""
    return F.when((age >= 0) & (age < n), F.lit(n - 1) - age)
