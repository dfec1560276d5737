"""Parent/child patterns: roll children up to the parent grain, then join.

The reference writes ``SELECT p.*, COUNT(c.id) ... LEFT JOIN c GROUP BY p.id``.
Grouping a wide parent row is not legal in Spark and would shuffle the
whole parent; instead the child side is aggregated by its foreign key first
(partial + final hash aggregate, map-side combine absorbs hot keys) and the
much smaller result is left-joined to the parent. Catalyst/AQE choose
broadcast or sort-merge for that join from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cumulative import global_running


def child_rollup(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str,
                 aggs: list[Column], fill: dict | None = None) -> DataFrame:
    """``parent`` left-joined with ``child`` aggregated per ``child_key``.

    ``fill`` maps output column -> value for parents without children
    (e.g. a count of 0); other aggregates stay null, as in SQL.
    """
    rolled = child.groupBy(F.col(child_key).alias(parent_key)).agg(*aggs)
    out = parent.join(rolled, on=parent_key, how="left")
    if fill:
        out = out.fillna(fill)
    return out


def nest_children(child: DataFrame, key: str, fields: list[str], name: str,
                  sort_fields: list[str] | None = None, descending: bool = False,
                  page_size: int | None = None) -> DataFrame:
    """Rows ``(key, page, name)``: the children of each key as ``array<struct<fields>>``.

    Each key has one row (page 0) with all its children, however many: the
    shape does not depend on the input's size. The array is sorted by
    ``sort_fields`` (then the other fields); ``descending`` reverses it.
    A caller that asks for ``page_size`` gets pages cut by position in that
    order, at most ``page_size`` children each; page 0 comes first.
    """
    sort_fields = sort_fields or []
    ordered = sort_fields + [f for f in fields if f not in sort_fields]
    if page_size:
        order = [F.col(f).desc() if descending else F.col(f).asc() for f in ordered]
        child = global_running(child.select(key, *ordered), [F.col(key), *order], count_col="_i")
        first = child.groupBy(F.col(key).alias("_key")).agg(F.min("_i").alias("_first"))
        child = (child.join(first, F.col(key).eqNullSafe(F.col("_key")))
                 .withColumn("page", F.floor((F.col("_i") - F.col("_first")) / page_size).cast("int")))
    else:
        child = child.withColumn("page", F.lit(0))
    packed = F.struct(*[F.col(f) for f in ordered])
    arr = F.array_sort(F.collect_list(packed))
    if descending:
        arr = F.reverse(arr)
    if sort_fields and ordered != fields:
        # restore the requested field order inside each element
        arr = F.transform(arr, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return child.groupBy(key, "page").agg(arr.alias(name))
