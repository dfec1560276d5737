"""Client telemetry: error and performance statistics.

``now`` is a parameter (a timestamp or a scalar Column such as the newest
event), never the clock. The window is ``ts > now - 24h`` with no upper
bound; future rows count in totals but fall outside every hourly bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_ts_col, exact_avg, exact_sum, hours_ago
from ..operators.buckets import bucket_index, zero_filled
from ..operators.latest import keep_last
from ..tables import Tables

# Fixed values from the reference's telemetry handlers.
WINDOW_HOURS = 24
SLOW_API_MS = 2000
FAILED_STATUS = 400
KEEP_ERRORS = 1000
KEEP_METRICS = 2000
CRITICAL = "critical"
PAGE_LOAD = "page_load"
API_CALL = "api_call"


def _recent(df: DataFrame, now: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    return df.where(F.col("ts").cast("timestamp") > now.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))


def error_stats(t: Tables, *, now, hours: int = WINDOW_HOURS) -> DataFrame:
    """Errors in the window: total, per type and per severity, in one pass (GROUPING SETS).

    Columns: ``dimension`` ('total' | 'type' | 'severity'), ``key``, ``errors``.
    """
    recent = _recent(t["error_log"], as_ts_col(now), hours)
    fine = recent.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("_n"))  # expand totals, not rows
    g = fine.groupingSets([["type"], ["severity"]], "type", "severity").agg(
        F.sum("_n").cast("bigint").alias("errors"), F.grouping_id().alias("_gid"))
    dimension = F.when(F.col("_gid") == 1, "type").otherwise("severity")
    key = F.when(F.col("_gid") == 1, F.col("type")).otherwise(F.col("severity"))
    # the total is a global aggregate, so it is present (0) even when the window is empty
    total = fine.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("errors")).select(
        F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("key"), "errors")
    return g.select(dimension.alias("dimension"), key.alias("key"), "errors").unionByName(total)


def error_hourly_trend(t: Tables, *, now, hours: int = WINDOW_HOURS) -> DataFrame:
    """Error count per hour bucket, zero-filled; index ``hours-1`` is the latest hour."""
    now_c = as_ts_col(now)
    recent = _recent(t["error_log"], now_c, hours)
    per = (recent.select(bucket_index(hours, hours_ago(now_c, "ts")).alias("hour_index"))
           .where(F.col("hour_index").isNotNull())
           .groupBy("hour_index").agg(F.count(F.lit(1)).alias("errors")))
    return zero_filled(t.spark, per, "hour_index", hours, {"errors": 0}).orderBy("hour_index")


def performance_stats(t: Tables, *, now, hours: int = WINDOW_HOURS) -> DataFrame:
    """Page-load average and count; API average, total, slow (> 2000 ms) and failed (status >= 400).

    Averages over no rows read 0; missing durations are ignored (D21).
    """
    m = _recent(t["metric_log"], as_ts_col(now), hours)
    is_page, is_api = F.col("type") == PAGE_LOAD, F.col("type") == API_CALL
    return m.agg(
        F.coalesce(exact_avg(F.when(is_page, F.col("duration"))), F.lit(0.0)).alias("page_load_avg"),
        F.count_if(is_page).alias("page_load_count"),
        F.coalesce(exact_avg(F.when(is_api, F.col("duration"))), F.lit(0.0)).alias("api_avg"),
        F.count_if(is_api).alias("api_total"),
        F.count_if(is_api & (F.col("duration") > SLOW_API_MS)).alias("api_slow"),
        F.count_if(is_api & (F.col("status") >= FAILED_STATUS)).alias("api_failed"),
    )


def performance_hourly_trend(t: Tables, *, now, hours: int = WINDOW_HOURS) -> DataFrame:
    """Duration sums per hour bucket for page loads and API calls, zero-filled."""
    now_c = as_ts_col(now)
    m = _recent(t["metric_log"], now_c, hours)
    per = (m.select(bucket_index(hours, hours_ago(now_c, "ts")).alias("hour_index"), "type", "duration")
           .where(F.col("hour_index").isNotNull())
           .groupBy("hour_index")
           .agg(exact_sum(F.when(F.col("type") == PAGE_LOAD, F.col("duration"))).alias("page_load_ms"),
                exact_sum(F.when(F.col("type") == API_CALL, F.col("duration"))).alias("api_ms")))
    return zero_filled(t.spark, per, "hour_index", hours,
                       {"page_load_ms": 0.0, "api_ms": 0.0}).orderBy("hour_index")


def critical_errors(batch: DataFrame) -> DataFrame:
    """An incoming batch's size and its number of critical reports."""
    return batch.agg(F.count(F.lit(1)).alias("processed"),
                     F.count_if(F.col("severity") == CRITICAL).alias("critical"))


def telemetry_keep_last(log: DataFrame, *, n: int = KEEP_ERRORS, order=("id",)) -> DataFrame:
    """Retention: the newest ``n`` rows by arrival sequence."""
    return keep_last(log, list(order), n)


def append_reports(log: DataFrame, batch: DataFrame, *, run_ts, keep: int = KEEP_ERRORS,
                   seq: str = "id", processed: bool | None = False) -> DataFrame:
    """Stamp an incoming batch (``server_ts`` = run time; ``processed`` = false for error reports,
    ``None`` for metrics), append it to the log and keep the newest ``keep`` rows by arrival
    sequence ``seq`` (ingestion assigns increasing sequence numbers)."""
    stamped = batch.withColumn("server_ts", as_ts_col(run_ts))
    if processed is not None:
        stamped = stamped.withColumn("processed", F.lit(processed))
    both = log.unionByName(stamped, allowMissingColumns=True)
    return keep_last(both, [seq], keep)
