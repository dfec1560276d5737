"""Exact interpolated quantiles of many groups without a buffer of a group's values in one task.

Equal values of a group are counted map-side; the counts run in the global order (group, value), range-partitioned
as in ``cumulative``, so a group with a third of all rows is spread over partitions. A group's base is the
running count before its first value; the two order statistics around ``q * (n - 1)`` are the least values whose
running count beyond the base exceeds their ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cumulative import global_running


def group_quantiles(df: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per ``key`` (null is a group) that has a value: the key and one double column per name of ``quantiles``,
    by the rule of ``percentile`` / ``quantile_cont``. Null values do not count; a key without any has no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = global_running(counts, [F.col("k").asc(), F.col("v").asc()], "c", sum_col="upto").select("k", "v", "c", "upto")
    groups = run.groupBy(F.col("k").alias("g")).agg(F.min(F.col("upto") - F.col("c")).alias("base"), F.sum("c").alias("n"))
    joined = run.join(groups, F.col("k").eqNullSafe(F.col("g")))
    reached = F.col("upto") - F.col("base")
    position = {name: (F.col("n") - 1).cast("double") * F.lit(q) for name, q in quantiles.items()}
    least = lambda rank: F.min(F.when(reached > rank, F.col("v"))).cast("double")
    found = joined.groupBy("k", "n").agg(*[least(f(p)).alias(f"{name}_{side}") for name, p in position.items()
                                           for side, f in (("low", F.floor), ("high", F.ceil))])
    return found.select(F.col("k").alias(key), *[
        (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (p - F.floor(p))).alias(name) for name, p in position.items()])
