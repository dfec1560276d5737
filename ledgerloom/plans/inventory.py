"""Flat-model stock and alert jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_ts_col, stock_status
from ..operators.dims import name_key
from ..operators.latest import latest_per_key
from ..tables import Tables

# The daily low-stock alert (server daily job).
LOW_STOCK_TYPE = "low_stock"
LOW_STOCK_SEVERITY = "warning"
# message template: "{product_name} 库存不足，当前: {current_stock}，最低: {min_stock}"
LOW_STOCK_PARTS = ("", " 库存不足，当前: ", "，最低: ")
INBOX_SIZE = 50


def inventory_status(t: Tables) -> DataFrame:
    """P12 + O2: stock status per product, lowest stock first."""
    inv = t["inventory"]
    return (inv.select("product_name", "current_stock", "min_stock", "max_stock",
                       stock_status(F.col("current_stock"), F.col("min_stock"), F.col("max_stock")).alias("status"))
            .orderBy(F.col("current_stock").asc(), F.col("product_name").asc()))


def low_stock_items(t: Tables) -> DataFrame:
    """Products whose stock is at or below their minimum (null minimum never qualifies)."""
    inv = t["inventory"]
    return inv.where(F.col("current_stock") <= F.col("min_stock")).select("product_name", "current_stock", "min_stock")


def _template_text(c):
    # a JavaScript template literal prints null as "null"
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def low_stock_alerts(t: Tables, *, run_ts, once_per_day: bool = False) -> DataFrame:
    """Alert rows for today's low-stock products.

    The reference inserts them every day (D16); ``once_per_day`` drops
    products that already have the same alert on the run day.
    """
    ts = as_ts_col(run_ts)
    low = low_stock_items(t)
    msg = F.concat(_template_text("product_name"), F.lit(LOW_STOCK_PARTS[1]), _template_text("current_stock"),
                   F.lit(LOW_STOCK_PARTS[2]), _template_text("min_stock"))
    out = low.select(
        F.lit(LOW_STOCK_TYPE).alias("type"),
        msg.alias("message"),
        F.lit(LOW_STOCK_SEVERITY).alias("severity"),
        F.lit(0).alias("is_read"),
        ts.alias("created_at"),
    )
    if once_per_day and "alerts" in t:
        seen = (t["alerts"].where((F.col("type") == LOW_STOCK_TYPE)
                                  & (F.to_date("created_at") == F.to_date(ts)))
                .select("message").distinct())
        out = out.join(seen, on="message", how="left_anti")
    return out


def alert_inbox(t: Tables, *, size: int = INBOX_SIZE) -> DataFrame:
    """O1: unread first, newest first, top ``size`` (id breaks timestamp ties)."""
    return t["alerts"].orderBy(F.col("is_read").asc(), F.col("created_at").desc(), F.col("id").desc()).limit(size)


def mark_alerts_read(alerts: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Set ``is_read = 1`` for the listed alert ids (unknown ids are ignored)."""
    marks = ids.select(F.col(id_col).alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = alerts.join(marks, on="id", how="left")
    typ = alerts.schema["is_read"].dataType
    return joined.select(*[
        F.when(F.col("_hit"), F.lit(1).cast(typ)).otherwise(F.col(c)).alias(c) if c == "is_read" else F.col(c)
        for c in alerts.columns
    ])


def upsert_inventory(inventory: DataFrame, changes: DataFrame, *, run_ts,
                     order: tuple[str, ...] = ("change_ts", "seq")) -> DataFrame:
    """Replace whole stock rows by ``product_name``; absent columns become null.

    The last change per name wins (``(change_ts, seq)`` order). The id of an
    existing name is kept; a new name gets a key derived from it (D14).
    ``last_updated`` is the run time.
    """
    cols = [c for c in inventory.columns if c not in ("id", "last_updated")]
    present = [c for c in cols if c in changes.columns]
    latest = latest_per_key(changes.select(*present, *order), ["product_name"], list(order))
    ids = inventory.select("product_name", F.col("id").alias("_old_id"))
    replaced = latest.join(ids, on="product_name", how="left")
    new_rows = replaced.select(*[
        (F.coalesce(F.col("_old_id"), name_key(F.col("product_name")).cast(inventory.schema["id"].dataType))
         .alias("id") if c == "id" else
         as_ts_col(run_ts).cast(inventory.schema["last_updated"].dataType).alias(c) if c == "last_updated" else
         (F.col(c).cast(inventory.schema[c].dataType).alias(c) if c in present else
          F.lit(None).cast(inventory.schema[c].dataType).alias(c)))
        for c in inventory.columns
    ])
    kept = inventory.join(latest.select("product_name"), on="product_name", how="left_anti")
    return kept.select(*inventory.columns).unionByName(new_rows)
