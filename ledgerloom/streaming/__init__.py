"""Streaming feeds."""

from .feeds import (  # noqa: F401
    closed_hours,
    hourly_errors,
    hourly_performance,
    late_rows,
    latest_tracking,
    read_latest_tracking,
    start_hourly_errors,
    start_hourly_performance,
    start_latest_tracking,
)
from .shipments import fold_shipments, read_late_changes, read_shipments, start_shipments  # noqa: F401
