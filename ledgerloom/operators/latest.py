"""Latest row per key, as an aggregate (no window sort).

``max_by(struct(row), struct(order))`` is an ordinary aggregate, so Spark
runs it as partial + final hash aggregation: a key that holds a third of the
rows is reduced map-side instead of being sorted inside one task, which is
what ``row_number() OVER (PARTITION BY key ORDER BY ...)`` would do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep, for each ``keys`` value, the row with the greatest ``order`` tuple.

    Ties on ``order`` are broken by the remaining columns (greatest wins), so
    the answer never depends on row arrival.
    """
    rest = [c for c in df.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in tail])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_row"))
    return agg.select(*keys, *[(F.col("_row")[f"_o{order.index(c)}"] if c in order else F.col("_row")[c]).alias(c)
                               for c in rest])


def keep_last(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows by arrival order (top-k, planned as TakeOrderedAndProject)."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
