"""Shipping: shipment and packing lists, KPIs, daily series, carriers, tracking (SURVEY A4, A5, A9,
A10, J5, J8, J9, O3, O5, O6, P5, P8, P14, W6, W8, W9, W13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_ts_col, check_days, exact_sum, int_sum, trailing_days
from ..operators.changes import Rule, apply_changes
from ..operators.dims import name_key
from ..operators.documents import child_lines, json_text, opened, parent_lines
from ..operators.rollup import child_rollup, nest_children
from ..schemas import SCHEMAS
from ..tables import Tables
from .receiving import _ids_filter, _json, _stringify_ts

# Statuses the reference writes or counts, and the packing priority order.
NEW_SHIPMENT_STATUS = "preparing"
SHIPPED_STATUSES = ("shipped", "in_transit", "delivered")
DELIVERED_STATUS = "delivered"
DONE_TASK_STATUS = "completed"
PRIORITY_RANK = {"high": 1, "medium": 2, "low": 3}


def shipping_order_list(t: Tables) -> DataFrame:
    """Each shipment with item count (0 when none) and quantity sum (null when none), newest first."""
    out = child_rollup(
        t["shipping_orders"], "id", t["shipping_items"], "shipping_order_id",
        [F.count(F.lit(1)).alias("item_count"), int_sum("quantity").alias("total_quantity")],
        fill={"item_count": 0})
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc())


def shipping_stats(t: Tables) -> DataFrame:
    """One-row KPIs; packing tasks count as pending unless 'completed' (null status drops out, P5)."""
    so = t["shipping_orders"]
    kpi = so.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status").isin(*SHIPPED_STATUSES)).alias("shipped_orders"),
        F.count_if(F.col("status") == DELIVERED_STATUS).alias("delivered_orders"),
        exact_sum("shipping_cost").alias("total_shipping_cost"),
    )
    pending = t["packing_tasks"].agg(F.count_if(F.col("status") != DONE_TASK_STATUS)).scalar()
    return kpi.select("*", pending.alias("pending_tasks"))


def shipping_daily(t: Tables, *, as_of, days: int = 30) -> DataFrame:
    """A10 (D19: the reference calls it monthly): shipments and cost per shipping day."""
    check_days(days)
    so = t["shipping_orders"].where(trailing_days(F.to_date("shipping_date"), as_of, days))
    return (so.groupBy(F.to_date("shipping_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("orders"), exact_sum("shipping_cost").alias("cost"))
            .orderBy("date"))


def carrier_list(t: Tables) -> DataFrame:
    """Active carriers by rating desc, name asc."""
    return t["carriers"].where(F.col("is_active") == 1).orderBy(F.col("rating").desc(), F.col("name").asc())


def packing_task_list(t: Tables) -> DataFrame:
    """Tasks with the shipment's customer name and address and an item count.

    ``customer_name`` comes from the shipment (null when unmatched), replacing
    the task's own column. Order: priority high/medium/low with unknown
    priorities first (null rank), then oldest first.
    """
    pt = t["packing_tasks"]
    so = t["shipping_orders"].select(F.col("id").alias("shipping_order_id"), "customer_name", "shipping_address")
    tasks = pt.drop("customer_name").join(so, on="shipping_order_id", how="left")
    out = child_rollup(tasks, "id", t["packing_items"], "packing_task_id",
                       [F.count(F.lit(1)).alias("item_count")], fill={"item_count": 0})
    rank = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).when(
        F.col("priority") == "low", 3)
    return out.orderBy(rank.asc_nulls_first(), F.col("created_at").asc(), F.col("id").asc())


def shipping_order_detail(t: Tables, *, ids=None, as_json: bool = False) -> DataFrame:
    """Each shipment with its ``items`` and ``tracking_info`` (newest scan first).

    One row a shipment at every size; ``page`` is always 0.
    """
    so = _ids_filter(t["shipping_orders"], ids)
    si = t["shipping_items"]
    item_fields = [c for c in si.columns if c != "shipping_order_id"]
    items = nest_children(si, "shipping_order_id", item_fields, "items", sort_fields=item_fields).drop("page")
    tr = _stringify_ts(t["tracking_records"])
    tr_fields = [c for c in tr.columns if c != "shipping_order_id"]
    tracking = nest_children(tr, "shipping_order_id", tr_fields, "tracking_info",
                             sort_fields=["timestamp", "id"], descending=True).drop("page")
    out = (so.join(items.withColumnRenamed("shipping_order_id", "id"), on="id", how="left")
           .join(tracking.withColumnRenamed("shipping_order_id", "id"), on="id", how="left")
           .withColumn("page", F.lit(0)))
    out = (out.withColumn("items", F.coalesce(F.col("items"), F.array().cast(items.schema["items"].dataType)))
           .withColumn("tracking_info", F.coalesce(F.col("tracking_info"),
                                                   F.array().cast(tracking.schema["tracking_info"].dataType))))
    if as_json:
        out = out.withColumn("items", _json(F.col("items"))).withColumn("tracking_info", _json(F.col("tracking_info")))
    return out


def shipping_order_lines(t: Tables, *, ids=None) -> DataFrame:
    """J9/O6 as document lines (id, section, position, line): ``shipping_order_detail``'s documents with no array in a row.

    Sections: the shipment, its items, a line between, its scans (newest first), the end.
    """
    so = _stringify_ts(_ids_filter(t["shipping_orders"], ids))
    known = so.select(F.col("id").alias("shipping_order_id"))
    items = t["shipping_items"].join(known, "shipping_order_id", "left_semi")
    item_fields = [c for c in items.columns if c != "shipping_order_id"]
    scans = _stringify_ts(t["tracking_records"]).join(known, "shipping_order_id", "left_semi")
    scan_fields = [c for c in scans.columns if c != "shipping_order_id"]
    newest = ["timestamp", "id", *[c for c in scan_fields if c not in ("timestamp", "id")]]
    return (parent_lines(so, "id", 0, opened(json_text("id", *[c for c in so.columns if c != "id"]), "items"))
            .unionByName(child_lines(items, "shipping_order_id", item_fields, [F.col(c) for c in item_fields], 1).withColumnRenamed("shipping_order_id", "id"))
            .unionByName(parent_lines(so, "id", 2, F.lit('],"tracking_info":[')))
            .unionByName(child_lines(scans, "shipping_order_id", scan_fields, [F.col(c).desc() for c in newest], 3).withColumnRenamed("shipping_order_id", "id"))
            .unionByName(parent_lines(so, "id", 4, F.lit("]}"))))


# ------------------------------------------------------------------ writes
def split_shipping_orders(requests: DataFrame, *, run_ts) -> tuple[DataFrame, DataFrame]:
    """Nested shipment requests -> (header rows with status 'preparing', item rows)."""
    header_cols = [c for c in requests.columns if c != "items"]
    keyed = requests.withColumn("id", name_key(F.col("shipping_no")))
    headers = keyed.select("id", *[c for c in header_cols if c not in ("id", "status")],
                           F.lit(NEW_SHIPMENT_STATUS).alias("status"), as_ts_col(run_ts).alias("created_at"))
    items = (keyed.select(F.col("id").alias("shipping_order_id"), F.posexplode("items").alias("item_index", "item"))
             .select("shipping_order_id", "item_index", "item.*"))
    return headers, items


def apply_shipping_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Status always; ``actual_delivery`` only from a change whose status is 'delivered'."""
    return apply_changes(orders, changes, ["id"], {
        "status": Rule(F.col("status")),
        "actual_delivery": Rule(F.col("actual_delivery"), guard=F.col("status") == DELIVERED_STATUS),
    })


def apply_packing_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Status always; ``actual_time`` and ``completed_at`` (= change time) only when the change
    supplies an actual time and its status is 'completed'. An actual time of 0 counts as not
    supplied, as in the reference."""
    guard = (F.col("status") == DONE_TASK_STATUS) & (F.col("actual_time") != 0)
    return apply_changes(tasks, changes, ["id"], {
        "status": Rule(F.col("status")),
        "actual_time": Rule(F.col("actual_time"), guard=guard),
        "completed_at": Rule(F.when(F.col("actual_time").isNotNull(), F.col("change_ts")), guard=guard),
    })


def append_tracking(scans: DataFrame) -> DataFrame:
    """Tracking rows to append, in the table's column order; missing columns are null in the declared type."""
    cols = ["shipping_order_id", "tracking_no", "timestamp", "location", "status", "description", "operator"]
    types = {f.name: f.dataType for f in SCHEMAS["tracking_records"].fields}
    return scans.select(*[F.col(c) if c in scans.columns else F.lit(None).cast(types[c]).alias(c) for c in cols])


def latest_tracking_status(scans: DataFrame) -> DataFrame:
    """X1 batch form: the newest scan per shipment (aggregate, no window sort)."""
    return (scans.groupBy("shipping_order_id")
            .agg(F.max_by(F.struct("timestamp", "status"), F.struct("timestamp", "id")).alias("_l"))
            .select("shipping_order_id", F.col("_l.timestamp").alias("last_timestamp"),
                    F.col("_l.status").alias("last_status")))
