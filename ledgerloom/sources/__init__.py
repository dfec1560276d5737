"""Sources and sinks: Parquet tables, import CSV, log JSON, report files, JDBC, snapshots."""

from .files import (  # noqa: F401
    read_error_log,
    read_import_csv,
    read_metric_log,
    with_line_numbers,
    write_report,
)
from .jdbc import jdbc_url, read_table, write_table  # noqa: F401
from .layout import change_fact, read_fact, write_fact  # noqa: F401
from .scan import read_json_array, read_quoted_csv  # noqa: F401
from .snapshot import backup, materialize, remove_table, restore  # noqa: F401
