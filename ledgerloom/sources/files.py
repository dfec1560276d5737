"""File sources and sinks.

* ``read_import_csv`` reads an import file by header as text and numbers its
  data rows 1..n in file order, the way the reference reports row errors.
  The numbering is distributed: rows are counted per file block (hidden
  ``_metadata`` columns), block offsets are a running sum over the small
  block table, and each row adds its position inside its block.
* ``read_error_log`` / ``read_metric_log`` read the JSON-array log files
  with a declared schema, a large array by many tasks (``scan``), and flatten them to the ``error_log`` /
  ``metric_log`` tables.
* ``write_report`` writes a DataFrame as CSV (RFC quoting, header, zeros
  kept), JSON or Parquet, optionally under the reference's header names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import read_json_array, read_quoted_csv

ERROR_REPORT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("stack", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("column", T.LongType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    T.StructField("serverTimestamp", T.StringType()),
    T.StructField("processed", T.BooleanType()),
])

METRIC_REPORT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("additionalData", T.StructType([T.StructField("status", T.IntegerType())])),
    T.StructField("serverTimestamp", T.StringType()),
])


def with_line_numbers(df: DataFrame, col: str = "line_no") -> DataFrame:
    """Number the rows of a freshly read file source 1..n per file, in file order.

    Must be applied directly on the reader's DataFrame (no shuffle before it),
    so partitions are file blocks read in order.
    """
    base = df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))
    blocks = base.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_first",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    # one row per file block: small and bounded by the number of input splits
    numbered = base.join(F.broadcast(blocks), on=["_file", "_block"], how="inner")
    line = (F.col("_offset") + (F.col("_mid") - F.col("_first")) + 1).cast("bigint")
    return numbered.select(line.alias(col), *df.columns)


def read_import_csv(spark: SparkSession, path: str, *, numbered: bool = True, multiline: bool = False) -> DataFrame:
    """S3: an import CSV read by header with every field as text (a UTF-8 BOM is dropped by the reader).

    ``multiline`` accepts quoted fields with line breaks (``scan.read_quoted_csv``: blocks are still read in
    parallel). ``line_no`` counts data rows either way.
    """
    if multiline:
        return read_quoted_csv(spark, path, numbered=numbered)
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path))
    return with_line_numbers(df) if numbered else df


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """Error log file (JSON array, read in parallel) -> ``error_log`` rows (``ts`` from epoch milliseconds)."""
    raw = read_json_array(spark, path, ERROR_REPORT_SCHEMA)
    return raw.select(F.col("id").alias("report_id"), "type", "severity",
                      F.timestamp_millis("timestamp").alias("ts"), F.col("context"), "processed")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Metric log file -> ``metric_log`` rows; ``status`` is the optional nested field."""
    raw = read_json_array(spark, path, METRIC_REPORT_SCHEMA)
    return raw.select("type", F.col("duration").cast("decimal(18,2)").alias("duration"),
                      F.col("additionalData.status").alias("status"),
                      F.timestamp_millis("timestamp").alias("ts"))


def write_report(df: DataFrame, path: str, fmt: str = "csv", headers: dict | None = None,
                 mode: str = "errorifexists") -> None:
    """Write a report. ``headers`` renames columns (e.g. to the reference's report headers).

    CSV is RFC style: fields with quotes, commas or newlines are quoted, a
    quote is doubled, zeros are written as 0, no BOM (D7).
    """
    if headers:
        df = df.select(*[F.col(c).alias(headers.get(c, c)) for c in df.columns])
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported file format: {fmt!r}")
