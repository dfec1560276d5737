"""Storage layout for fact tables (SURVEY 4.1: the reference's indexes become layout).

Facts are written partitioned by a day or month column (trailing-window
reports prune whole folders) and sorted by their join key inside each file
(Parquet min/max statistics then skip row groups for key lookups). The sort
is ``sortWithinPartitions`` after a repartition on the partition column plus
a hash spread, so no single task writes a hot month.

``change_fact`` applies a batch of changes to such a table and rewrites only
the folders that hold a changed row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .snapshot import materialize, remove_table


def _folder_column(date_col: str, grain: str) -> str:
    if grain not in ("day", "month"):
        raise ValueError("grain must be 'day' or 'month'")
    return date_col if grain == "day" else "_part"


def _laid_out(df: DataFrame, date_col: str, sort_by: list[str], grain: str, files_per_partition: int) -> DataFrame:
    part_col = _folder_column(date_col, grain)
    out = df if grain == "day" else df.withColumn("_part", F.date_format(date_col, "yyyy-MM"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in sort_by]), F.lit(files_per_partition))
    return out.repartition(part_col, spread).sortWithinPartitions(part_col, *sort_by)


def write_fact(df: DataFrame, path: str, *, date_col: str, sort_by: list[str], grain: str = "day",
               files_per_partition: int = 8, mode: str = "errorifexists") -> None:
    """Write a fact table partitioned by time and key-sorted within files.

    ``grain="day"`` partitions by ``date_col`` itself, so the reports'
    ``date >= as_of - n`` filters become partition filters. ``grain="month"``
    adds a ``_part`` (yyyy-MM) folder column for coarser layouts; filters must
    then name ``_part`` to prune.
    """
    out = _laid_out(df, date_col, sort_by, grain, files_per_partition)
    out.write.mode(mode).partitionBy(_folder_column(date_col, grain)).parquet(path)


def read_fact(spark, path: str) -> DataFrame:
    """Read a fact written by ``write_fact`` (its partition column drives partition pruning)."""
    return spark.read.parquet(path)


def _among(col: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    return F.coalesce(col.isin(known), F.lit(False)) | (col.isNull() if None in values else F.lit(False))


def change_fact(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], apply: Callable[[DataFrame], DataFrame], *,
                date_col: str, sort_by: list[str], grain: str = "day", files_per_partition: int = 8, run_id: str | None = None) -> int:
    """Rewrite the folders of a fact table (``write_fact``) that hold rows named by ``changes``; the number of these folders.

    The folders are found by a semi-join that reads only ``keys`` and the folder names; the driver gets their names, at most one a
    folder, all of which it lists for any read. ``apply`` is given the rows of these folders, must return each of them with all
    columns it was given (as ``apply_changes`` does), and may not change the date that names a row's folder: else ``ValueError``,
    and nothing is written. Changes without a matching row, null keys and empty ``changes`` touch nothing; a row without a date
    lies in the folder of null dates like any other.

    New rows are first written whole under ``spark.checkpoint.dir``, then exchanged by dynamic partition overwrite. If the job is
    lost during the exchange, calling it again with the same ``run_id`` finishes it from these rows, without reading the table.
    """
    part_col = _folder_column(date_col, grain)
    name = f"change-{run_id or uuid.uuid4().hex}"
    staged = _staged(spark, name)
    if staged is None:
        fact = read_fact(spark, path)
        named = changes.select(*keys).distinct()
        folders = [r[0] for r in fact.select(*keys, *[c for c in [part_col] if c not in keys]).join(named, keys, "left_semi")
                   .select(part_col).distinct().collect()]
        if not folders:
            return 0
        rows = fact.where(_among(F.col(part_col), folders)).withColumn("_was", F.col(part_col).cast("string"))
        staged = materialize(spark, apply(rows), name)
        if staged.count() != rows.count():
            remove_table(spark, staged)
            raise ValueError("apply must return every row it was given, once")
    now = F.col(date_col).cast("string") if grain == "day" else F.date_format(date_col, "yyyy-MM")
    if not staged.where(~F.col("_was").eqNullSafe(now)).isEmpty():
        remove_table(spark, staged)
        raise ValueError(f"apply must not move a row to another folder: {date_col} changed")
    out = _laid_out(staged.drop("_was", "_part"), date_col, sort_by, grain, files_per_partition)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    count = staged.select("_was").distinct().count()
    remove_table(spark, staged)
    return count


def _staged(spark: SparkSession, name: str) -> DataFrame | None:
    """The rows that an earlier call with this name wrote in full, if any."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) else None
