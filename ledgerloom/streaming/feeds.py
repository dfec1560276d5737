"""Structured Streaming versions of the reference's append feeds.

* X1 tracking scans: latest status per shipment, kept as streaming state
  (``max(struct(ts, id, status))`` per shipment, update mode) and merged into
  a snapshot table by ``foreachBatch``.
* X2 error reports: hourly counts per type and severity, event-time tumbling
  windows with a watermark (append mode emits a window once it closes).
* X3 performance metrics: hourly duration sums, slow and failed API calls.

X2 and X3 take ``report_id``: a report seen before within the watermark (a file
sent again) counts once. ``closed_hours`` fills the hours without reports with
zeros, and ``late_rows`` says how many rows came after the watermark.

Event time must be ``TIMESTAMP`` (``withWatermark`` rejects TIMESTAMP_NTZ),
so inputs are cast first. Checkpoints go under ``spark.checkpoint.dir``
(a shared folder on a cluster) unless a location is passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.telemetry import API_CALL, FAILED_STATUS, PAGE_LOAD, SLOW_API_MS
from ..session import ensure_checkpoint_dir


def _event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def latest_tracking(scans: DataFrame) -> DataFrame:
    """Newest scan per shipment (streaming aggregation; use output mode 'update' or 'complete')."""
    s = _event_time(scans, "timestamp")
    return (s.groupBy("shipping_order_id")
            .agg(F.max(F.struct("timestamp", "id", "status")).alias("_l"))
            .select("shipping_order_id", F.col("_l.timestamp").alias("last_timestamp"),
                    F.col("_l.status").alias("last_status")))


def _once(df: DataFrame, watermark: str, report_id: str | None) -> DataFrame:
    """``df`` with its watermark; equal ids within it count once (append mode only). Rows without an id all count."""
    marked = _event_time(df, "ts").withWatermark("ts", watermark)
    if report_id is None:
        return marked
    # a row without an id is told apart by all its columns' text, so that it is never taken for another report
    own = F.coalesce(F.col(report_id).cast("string"), F.concat(F.lit("row "), F.to_json(F.struct(*df.columns))))
    return marked.withColumn("_report", own).dropDuplicatesWithinWatermark(["_report"]).drop("_report")


def hourly_errors(errors: DataFrame, *, watermark: str = "1 hour", report_id: str | None = None) -> DataFrame:
    """Error counts per hour window, type and severity; with ``report_id`` a report sent again counts once."""
    e = _once(errors, watermark, report_id)
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "type", "severity").agg(F.count(F.lit(1)).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "type", "severity", "errors")


def hourly_performance(metrics: DataFrame, *, watermark: str = "1 hour", report_id: str | None = None) -> DataFrame:
    """Per hour window: page-load and API duration sums, slow and failed API calls; ``report_id`` as in X2."""
    m = _once(metrics, watermark, report_id)
    is_page, is_api = F.col("type") == PAGE_LOAD, F.col("type") == API_CALL
    g = m.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.sum(F.when(is_page, F.col("duration").cast("decimal(18,2)"))).cast("double").alias("page_load_ms"),
        F.sum(F.when(is_api, F.col("duration").cast("decimal(18,2)"))).cast("double").alias("api_ms"),
        F.count_if(is_api & (F.col("duration") > SLOW_API_MS)).alias("api_slow"),
        F.count_if(is_api & (F.col("status") >= FAILED_STATUS)).alias("api_failed"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "page_load_ms", "api_ms", "api_slow", "api_failed")


def closed_hours(windows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Hourly windows with the hours between the first and the last one filled with zeros, for each combination of ``keys`` seen.

    A combination makes its own hours (no pairing of rows), so the work is hours x combinations. No windows give no rows; null
    keys are a combination like any other.
    """
    span = windows.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    kinds = windows.select(*keys).distinct() if keys else windows.limit(1).select()
    hours = kinds.withColumn("window_start", F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))))
    zeros = hours.select("window_start", *keys, *[F.lit(0).cast(windows.schema[v].dataType).alias(v) for v in values])
    both = windows.select("window_start", *keys, *[F.coalesce(v, F.lit(0)).cast(windows.schema[v].dataType).alias(v) for v in values]).unionByName(zeros)
    # a window of the feed occurs once, so adding its zeros leaves its values
    summed = both.groupBy("window_start", *keys).agg(*[F.sum(v).cast(windows.schema[v].dataType).alias(v) for v in values])
    return summed.select("window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), *keys, *values)


def late_rows(query: StreamingQuery) -> int:
    """Rows that ``query`` left out because they came after the watermark, over the progress reports Spark still holds.

    With ``report_id`` the first stateful operator sees single rows, so the number is exact; without it Spark counts what is left of
    the late rows after partial aggregation.
    """
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def start_latest_tracking(spark: SparkSession, source_dir: str, schema, snapshot_dir: str, *,
                          name: str = "latest_tracking", checkpoint: str | None = None,
                          available_now: bool = True) -> StreamingQuery:
    """Run X1 over Parquet files landing in ``source_dir``.

    The streaming state holds the newest scan per shipment; each micro-batch
    appends its updated shipments, tagged with the batch id, under
    ``snapshot_dir``. A replayed batch appends identical rows, so
    ``read_latest_tracking`` (newest batch per shipment) stays exact.
    """
    scans = spark.readStream.schema(schema).parquet(source_dir)
    latest = latest_tracking(scans)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(snapshot_dir)

    writer = (latest.writeStream.outputMode("update").foreachBatch(append).queryName(name)
              .option("checkpointLocation", checkpoint or checkpoint_location(spark, name)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_latest_tracking(spark: SparkSession, snapshot_dir: str) -> DataFrame:
    """Current X1 snapshot: for each shipment the row of its newest batch."""
    rows = spark.read.parquet(snapshot_dir)
    g = rows.groupBy("shipping_order_id").agg(
        F.max(F.struct("batch_id", "last_timestamp", "last_status")).alias("_r"))
    return g.select("shipping_order_id", F.col("_r.last_timestamp").alias("last_timestamp"),
                    F.col("_r.last_status").alias("last_status"))


def _start_windowed(spark: SparkSession, frame: DataFrame, sink_dir: str, name: str,
                    checkpoint: str | None, available_now: bool) -> StreamingQuery:
    writer = (frame.writeStream.outputMode("append").format("parquet").queryName(name)
              .option("checkpointLocation", checkpoint or checkpoint_location(spark, name)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)


def start_hourly_errors(spark: SparkSession, source_dir: str, schema, sink_dir: str, *,
                        name: str = "hourly_errors", checkpoint: str | None = None, watermark: str = "1 hour",
                        available_now: bool = True, report_id: str | None = None) -> StreamingQuery:
    """Run X2 over Parquet files landing in ``source_dir``; closed hour windows are appended to
    ``sink_dir`` (exactly once through the checkpoint)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    return _start_windowed(spark, hourly_errors(stream, watermark=watermark, report_id=report_id), sink_dir, name, checkpoint,
                           available_now)


def start_hourly_performance(spark: SparkSession, source_dir: str, schema, sink_dir: str, *,
                             name: str = "hourly_performance", checkpoint: str | None = None,
                             watermark: str = "1 hour", available_now: bool = True,
                             report_id: str | None = None) -> StreamingQuery:
    """Run X3 over Parquet files landing in ``source_dir``; closed hour windows go to ``sink_dir``."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    return _start_windowed(spark, hourly_performance(stream, watermark=watermark, report_id=report_id), sink_dir, name, checkpoint,
                           available_now)
