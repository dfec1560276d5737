"""Running totals over a global order without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task.
``global_running`` instead:

1. range-partitions the rows on the sort key (``repartitionByRange``: the
   key is sampled, so ties and hot values are split by the later sort
   columns) and tags each row with its partition number;
2. writes that tagged frame under ``spark.checkpoint.dir`` so the
   partition assignment is fixed for every later read (a re-sampled range
   partitioner could otherwise draw different bounds);
3. sums each partition (one row per partition) and turns the sums into
   offsets with a window over that tiny table;
4. computes the in-partition running sum / row number with a window
   partitioned by the partition number and adds the offset.

Every step is parallel; the only single-task steps touch one row per
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import materialize


def global_running(df: DataFrame, order: list[Column], value: str | None = None, *,
                   partitions: int | None = None, sum_col: str = "running_sum",
                   count_col: str = "running_count") -> DataFrame:
    """``df`` plus the running sum of ``value`` (if given) and the running row count (1-based)
    in the total order ``order`` (which must be a total order for a deterministic count)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    tagged = materialize(spark, tagged)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value:
        aggs.append(F.sum(value).alias("_s"))
    per = tagged.groupBy("_part").agg(*aggs)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_off")]
    if value:
        offs.append(F.sum("_s").over(before).alias("_s_off"))
    per = per.select("_part", *offs)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = tagged.join(F.broadcast(per), on="_part", how="inner")
    cols = [F.col(c) for c in df.columns]
    cols.append((F.col("_n_off") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
                .cast("bigint").alias(count_col))
    if value:
        run = F.sum(value).over(within)
        cols.append(F.when(F.col("_s_off").isNull(), run).otherwise(F.col("_s_off") + run).alias(sum_col))
    return j.select(*cols)


def global_running_min(df: DataFrame, order: list[Column], value: Column, out: str, *,
                       partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out``: the minimum of ``value`` (any orderable type, nulls ignored) over all
    rows up to and including each row in the total order ``order``; same range-partitioned
    scheme as ``global_running`` (per-partition minima become offsets)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.withColumn("_v", value).repartitionByRange(n, *order)
              .withColumn("_part", F.spark_partition_id()))
    tagged = materialize(spark, tagged)
    per = tagged.groupBy("_part").agg(F.min("_v").alias("_m"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per = per.select("_part", F.min("_m").over(before).alias("_off"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = tagged.join(F.broadcast(per), on="_part", how="inner")
    run = F.min("_v").over(within)
    best = F.when(F.col("_off").isNull(), run).when(run.isNull(), F.col("_off")).otherwise(F.least(F.col("_off"), run))
    return j.select(*[F.col(c) for c in df.columns], best.alias(out))


def global_running_max(df: DataFrame, order: list[Column], values: dict[str, Column], *, partitions: int | None = None) -> DataFrame:
    """``df`` plus, for each name of ``values``, the maximum of its value (any orderable type, nulls ignored) over all
    rows up to and including each row in the total order ``order``: one sort for all of them, same scheme as
    ``global_running``. A value that starts with a group the order ascends in starts anew with each group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = {name: f"_v_{name}" for name in values}
    tagged = df.withColumns({raw[name]: v for name, v in values.items()}).repartitionByRange(n, *order)
    tagged = materialize(spark, tagged.withColumn("_part", F.spark_partition_id()))
    per = tagged.groupBy("_part").agg(*[F.max(raw[name]).alias(name) for name in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per = per.select("_part", *[F.max(name).over(before).alias(f"_off_{name}") for name in values])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = tagged.join(F.broadcast(per), on="_part", how="inner")
    return j.select(*df.columns, *[F.greatest(F.col(f"_off_{name}"), F.max(raw[name]).over(within)).alias(name) for name in values])
