"""Bindings of library jobs to the driver's data (one ``@query`` per catalog key).

Report days and 'now' come from the data (newest order day, newest event),
never from the clock, so every run gives the same answer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import query
from .fixtures import as_of_date, now_ts, read_base
from .functions.scalar import numeric_prefix_int
from .operators.dims import get_or_create
from .operators.rollup import nest_children
from .plans import exports, imports, insights, inventory, normalise, receiving, sales, shipping, telemetry
from .session import ensure_checkpoint_dir
from .sources.layout import change_fact, read_fact, write_fact
from .sources.scan import read_quoted_csv
from .tables import Tables


# ---------------------------------------------------------------- flat model
@query("sales_trend")
def _sales_trend(t):
    return sales.sales_trend(t, as_of=as_of_date(t), days=30)


@query("sales_trend_7")
def _sales_trend_7(t):
    return sales.sales_trend(t, as_of=as_of_date(t), days=7)


@query("dashboard_overview")
def _dashboard(t):
    return sales.dashboard_overview(t, as_of=as_of_date(t))


@query("sales_list")
def _sales_list(t):
    return sales.sales_list(t)


@query("record_sales")
def _record_sales(t):
    batch = t["sales"].select("date", "product_name", "category", "quantity", "unit_price", "customer_name")
    return sales.record_sales(batch, run_ts=as_of_date(t))


@query("apply_sales_to_stock")
def _apply_sales(t):
    return sales.apply_sales_to_stock(t["inventory"], t["sales"])


@query("inventory_status")
def _inventory_status(t):
    return inventory.inventory_status(t)


@query("low_stock_items")
def _low_stock_items(t):
    return inventory.low_stock_items(t)


@query("low_stock_alerts")
def _low_stock_alerts(t):
    return inventory.low_stock_alerts(t, run_ts=as_of_date(t))


@query("alert_inbox")
def _alert_inbox(t):
    return inventory.alert_inbox(t)


@query("mark_alerts_read")
def _mark_alerts_read(t):
    # read requests: the 'resolved' changes of the change feed name alert ids
    ids = t["status_changes"].where(F.col("status") == "resolved").select(F.col("seq").alias("id"))
    return inventory.mark_alerts_read(t["alerts"], ids)


def _import_stock_changes(t):
    rows = t["import_rows"]
    return rows.where(F.col("name") != "").select(
        F.concat(F.col("name"), F.lit(" #"), (F.col("line_no") - 1).cast("string")).alias("product_name"),
        F.when(F.col("category") != "", F.col("category")).alias("category"),
        numeric_prefix_int("stock").alias("current_stock"),
        F.col("supplier"),
        as_of_date(t).cast("timestamp").alias("change_ts"),
        F.col("line_no").alias("seq"),
    )


@query("upsert_inventory")
def _upsert_inventory(t):
    return inventory.upsert_inventory(t["inventory"], _import_stock_changes(t), run_ts=as_of_date(t))


# ---------------------------------------------------------------- receiving


@query("receiving_order_list")
def _receiving_order_list(t):
    return receiving.receiving_order_list(t)


@query("receiving_stats")
def _receiving_stats(t):
    return receiving.receiving_stats(t)


@query("receiving_daily")
def _receiving_daily(t):
    return receiving.receiving_daily(t, as_of=as_of_date(t))


@query("exception_list")
def _exception_list(t):
    return receiving.exception_list(t)


@query("supplier_evaluation_list")
def _supplier_evaluation_list(t):
    return receiving.supplier_evaluation_list(t)


@query("inspection_report_detail")
def _inspection_report_detail(t):
    return receiving.inspection_report_detail(t, as_json=True)


@query("receiving_order_detail")
def _receiving_order_detail(t):
    return receiving.receiving_order_detail(t, as_json=True)


@query("inspection_report_lines")
def _inspection_report_lines(t):
    return receiving.inspection_report_lines(t)


@query("receiving_order_lines")
def _receiving_order_lines(t):
    return receiving.receiving_order_lines(t)


@query("apply_receiving_status")
def _apply_receiving_status(t):
    return receiving.apply_receiving_status(t["receiving_orders"], t["status_changes"])


@query("apply_exception_status")
def _apply_exception_status(t):
    # the change feed's dates act as the supplied resolution dates
    ch = t["status_changes"].withColumn("resolved_date", F.col("actual_delivery"))
    return receiving.apply_exception_status(t["exception_records"], ch)


@query("apply_receiving_items")
def _apply_receiving_items(t):
    # receipt lines keyed by (receipt, product); every change row re-states the line's results
    items = t["receiving_items"].withColumnRenamed("product_id", "id")
    ch = t["receiving_items"].select(
        F.col("product_id").alias("id"), "receiving_order_id",
        (F.col("ordered_quantity") - F.col("rejected_quantity")).alias("received_quantity"),
        F.col("rejected_quantity"),
        F.col("expiry_date").cast("timestamp").alias("change_ts"),
        F.col("ordered_quantity").cast("bigint").alias("seq"))
    return receiving.apply_receiving_items(items, ch)


def _inspection_split(t):
    checks = receiving._checks_per_report(t).withColumnRenamed("inspection_report_id", "id")
    reports = t["inspection_reports"].join(checks, on="id", how="left").withColumn(
        "quality_checks", F.coalesce("quality_checks", F.array().cast(checks.schema["quality_checks"].dataType)))
    # every other report has a photo, named after it
    photo = F.concat(F.lit("report-"), F.col("id").cast("string"), F.lit(".jpg"))
    reports = reports.withColumn("photos", F.when(F.col("id") % 2 == 0, F.array(photo)))
    return receiving.apply_inspection_reports(reports, t["receiving_orders"], run_ts=as_of_date(t))


@query("apply_inspection_reports")
def _apply_inspection_reports(t):
    return _inspection_split(t)[0]


@query("inspection_report_rows")
def _inspection_report_rows(t):
    return _inspection_split(t)[1]


@query("inspection_check_rows")
def _inspection_check_rows(t):
    return _inspection_split(t)[2]


@query("supplier_rating")
def _supplier_rating(t):
    return receiving.supplier_rating(t["supplier_evaluations"].drop("overall_rating"))


@query("split_receiving_orders")
def _split_receiving_orders(t):
    ro, ri = t["receiving_orders"], t["receiving_items"]
    item_fields = ["product_id", "ordered_quantity", "received_quantity", "rejected_quantity", "expiry_date"]
    # one request per receipt, with all its items
    nested = nest_children(ri, "receiving_order_id", item_fields, "items", sort_fields=item_fields).drop("page")
    requests = (ro.select(F.col("id").alias("receiving_order_id"), "receiving_no", "supplier_id", "supplier_name",
                          "planned_date", "total_amount")
                .join(nested, on="receiving_order_id", how="inner").drop("receiving_order_id"))
    headers, items = receiving.split_receiving_orders(requests, run_ts=as_of_date(t))
    headers = headers.dropDuplicates(["id"])
    return (items.join(headers.select(F.col("id").alias("receiving_order_id"), "receiving_no", "status"),
                       on="receiving_order_id").drop("receiving_order_id"))


# ---------------------------------------------------------------- shipping
@query("shipping_order_list")
def _shipping_order_list(t):
    return shipping.shipping_order_list(t)


@query("shipping_stats")
def _shipping_stats(t):
    return shipping.shipping_stats(t)


@query("shipping_daily")
def _shipping_daily(t):
    return shipping.shipping_daily(t, as_of=as_of_date(t))


@query("carrier_list")
def _carrier_list(t):
    return shipping.carrier_list(t)


@query("packing_task_list")
def _packing_task_list(t):
    return shipping.packing_task_list(t)


@query("shipping_order_detail")
def _shipping_order_detail(t):
    return shipping.shipping_order_detail(t, as_json=True)


@query("shipping_order_lines")
def _shipping_order_lines(t):
    return shipping.shipping_order_lines(t)


@query("apply_shipping_status")
def _apply_shipping_status(t):
    return shipping.apply_shipping_status(t["shipping_orders"], t["status_changes"])


@query("apply_shipping_status_fact")
def _apply_shipping_status_fact(t):
    # the shipments as a table by month, of which the changes rewrite the months they touch
    spark, orders, changes = t.spark, t["shipping_orders"], t["status_changes"]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/shipments-{uuid.uuid4().hex}"
    by = {"date_col": "shipping_date", "sort_by": ["id"], "grain": "month", "files_per_partition": 1}
    write_fact(orders, path, **by)
    change_fact(spark, path, changes, ["id"], lambda rows: shipping.apply_shipping_status(rows, changes), **by)
    return read_fact(spark, path).select(*orders.columns)


@query("apply_packing_status")
def _apply_packing_status(t):
    # the change feed's optional numeric value stands for the reported packing minutes
    ch = t["status_changes"].withColumn("actual_time", F.floor("quality_score").cast("int"))
    return shipping.apply_packing_status(t["packing_tasks"], ch)


@query("split_shipping_orders")
def _split_shipping_orders(t):
    so, si = t["shipping_orders"], t["shipping_items"]
    item_fields = ["product_id", "line_no", "quantity"]
    nested = nest_children(si, "shipping_order_id", item_fields, "items", sort_fields=item_fields).drop("page")
    requests = (so.select(F.col("id").alias("shipping_order_id"), "shipping_no", "customer_name", "shipping_address",
                          "carrier_code", "shipping_date", "expected_delivery")
                .join(nested, on="shipping_order_id", how="inner").drop("shipping_order_id"))
    headers, items = shipping.split_shipping_orders(requests, run_ts=as_of_date(t))
    headers = headers.dropDuplicates(["id"])
    return (items.join(headers.select(F.col("id").alias("shipping_order_id"), "shipping_no", "customer_name",
                                      "status"), on="shipping_order_id").drop("shipping_order_id"))


@query("append_tracking")
def _append_tracking(t):
    # every scan of the feed again, read by one of seven people
    return shipping.append_tracking(t["tracking_records"].withColumn("operator", F.concat(F.lit("operator "), F.col("id") % 7)))


@query("append_exceptions")
def _append_exceptions(t):
    batch = t["exception_records"].select("receiving_order_id", "supplier_name", "exception_type", "responsible_party", "financial_impact")
    return receiving.append_exceptions(batch, run_ts=as_of_date(t))


@query("latest_tracking_status")
def _latest_tracking_status(t):
    return shipping.latest_tracking_status(t["tracking_records"])


# ---------------------------------------------------------------- telemetry


@query("error_stats")
def _error_stats(t):
    return telemetry.error_stats(t, now=now_ts(t))


@query("error_hourly_trend")
def _error_hourly_trend(t):
    return telemetry.error_hourly_trend(t, now=now_ts(t))


@query("performance_stats")
def _performance_stats(t):
    return telemetry.performance_stats(t, now=now_ts(t, "metric_log"))


@query("performance_hourly_trend")
def _performance_hourly_trend(t):
    return telemetry.performance_hourly_trend(t, now=now_ts(t, "metric_log"))


@query("critical_errors")
def _critical_errors(t):
    return telemetry.critical_errors(t["error_log"])


@query("telemetry_keep_last")
def _telemetry_keep_last(t):
    return telemetry.telemetry_keep_last(t["error_log"], n=telemetry.KEEP_ERRORS)


# ---------------------------------------------------------------- exports
@query("export_products")
def _export_products(t):
    return exports.export_products(t)


@query("export_customers")
def _export_customers(t):
    return exports.export_customers(t)


@query("export_sales")
def _export_sales(t):
    return exports.export_sales(t)


@query("export_sales_range")
def _export_sales_range(t):
    day = as_of_date(t)
    return exports.export_sales(t, {"startDate": F.date_sub(day, 90), "endDate": day})


@query("export_inventory")
def _export_inventory(t):
    return exports.export_inventory(t)


@query("export_financial")
def _export_financial(t):
    return exports.export_financial(t)


@query("export_financial_range")
def _export_financial_range(t):
    day = as_of_date(t)
    return exports.export_financial(t, {"startDate": F.date_sub(day, 90), "endDate": day})


# ---------------------------------------------------------------- imports, normalisation, seeds


def _product_import_rows(t):
    r = t["import_rows"]
    return r.select("line_no", "name", F.col("stock").alias("current_stock"), "category", "supplier")


@query("import_products")
def _import_products(t):
    res = imports.import_products(t["products"], t["categories"], t["suppliers"], _product_import_rows(t))
    return res.accepted.select("line_no", "name", "category", "supplier", "barcode", "brand", "unit",
                               "current_stock", "min_stock", "max_stock", "cost_price", "selling_price",
                               "wholesale_price", F.col("category_id").isNotNull().alias("category_known"),
                               F.col("supplier_id").isNotNull().alias("supplier_known"))


@query("import_customers")
def _import_customers(t):
    rows = t["customers"].select(F.col("id").alias("line_no"), "name", "customer_type", "member_level")
    res = imports.import_customers(t["customers"], rows)
    return res.accepted.select("line_no", "name", "phone", "email", "address", "customer_type", "member_level")


def _stock_import(t):
    # product names without the '#key' suffix repeat (64 names over the parts): D4 applies
    products = t["products"].withColumn("name", F.regexp_replace("name", " #[0-9]+$", ""))
    rows = t["import_rows"].select("line_no", "name", "stock")
    return imports.import_inventory(products, rows, run_ts=as_of_date(t))


@query("import_inventory")
def _import_inventory(t):
    return _stock_import(t).table.select("id", "name", "current_stock")


@query("import_summary")
def _import_summary(t):
    return _stock_import(t).summary()


@query("import_errors")
def _import_errors(t):
    return _stock_import(t).rejects


@query("dim_get_or_create")
def _dim_get_or_create(t):
    cats = t["categories"]
    new_dim, _ = get_or_create(cats, t["import_rows"].select(F.col("category").alias("name")))
    old = cats.select("name").distinct().withColumn("_old", F.lit(True))
    return new_dim.join(old, on="name", how="left").select("name", F.col("_old").isNull().alias("is_new"))


@query("normalise_sales")
def _normalise_sales(t):
    n = normalise.normalise_sales(t["sales"], t["customers"], t["products"])
    orders = n.orders.select(F.col("id").alias("order_id"), "order_date", "customer_id")
    return (n.lines.join(orders, on="order_id", how="left")
            .select("order_date", "customer_id", "product_id", "quantity", "unit_price", "line_total"))


@query("normalise_inventory")
def _normalise_inventory(t):
    cats = normalise.seed_if_absent(t["categories"], normalise.seed_frame(t.spark, "categories"), "name")
    out = normalise.normalise_inventory(t["inventory"], cats, run_ts=as_of_date(t))
    return out.drop("id")


@query("seed_if_absent")
def _seed_if_absent(t):
    sups = normalise.seed_if_absent(t["suppliers"], normalise.seed_frame(t.spark, "suppliers"), "name",
                                    defaults=normalise.SEED_DEFAULTS["suppliers"])
    return sups.select("name", "contact_person", "phone", "credit_rating", "is_active")


# ---------------------------------------------------------------- files read in parallel
@query("quoted_csv_documents")
def _quoted_csv_documents(t):
    # every document as a CSV row, texts with their line breaks and quotes in quoted fields, and read back
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/files/{uuid.uuid4().hex}"
    (read_base(t.spark, t.params["sf_dir"], "documents").select("doc_id", "text", "lang", "source").write
     .options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    back = read_quoted_csv(t.spark, path, numbered=False)
    text = lambda c: F.coalesce(c, F.lit(""))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.encode(text("text"), "UTF-8"), 256).alias("text_sha256"),
                       text("lang").alias("lang"), text("source").alias("source"))


# ---------------------------------------------------------------- analytics
def _product_graph(t, parent):
    """Products as categories, each under the one that ``parent`` names."""
    return Tables.from_frames(t.spark, {"categories": t["products"].select("id", "name", parent.cast("bigint").alias("parent_id"))})


@query("category_tree_products")
def _category_tree_products(t):
    # product k stands under product k / 2, so the tree grows with the products
    return insights.category_tree(_product_graph(t, F.when(F.col("id") >= 2, F.floor(F.col("id") / 2))))


@query("category_cycles_products")
def _category_cycles_products(t):
    # of ten products the first three stand in a circle, three below them, four are roots
    last = F.col("id") % 10
    parent = F.when(last < 2, F.col("id") + 1).when(last == 2, F.col("id") - 2).when(last < 6, F.col("id") - 3)
    return insights.category_cycles(_product_graph(t, parent))


for _key, _fn, _needs_day in [
    ("stock_ledger", insights.stock_ledger, False),
    ("category_tree", insights.category_tree, False),
    ("order_total_check", insights.order_total_check, False),
    ("gross_margin", insights.gross_margin, False),
    ("customer_rollup", insights.customer_rollup, False),
    ("receivables_aging", insights.receivables_aging, True),
    ("purchase_progress", insights.purchase_progress, False),
    ("finance_summary", insights.finance_summary, False),
    ("account_balance", insights.account_balance, False),
    ("promotion_match", insights.promotion_match, False),
    ("freight_quote", insights.freight_quote, False),
    ("delivery_performance", insights.delivery_performance, False),
    ("supplier_scorecard", insights.supplier_scorecard, False),
    ("receipt_quality", insights.receipt_quality, False),
    ("packing_performance", insights.packing_performance, False),
    ("packing_performance_distributed", lambda t: insights.packing_performance(t, distributed=True), False),
    ("exception_cost", insights.exception_cost, False),
    ("expiry_watch", insights.expiry_watch, True),
    ("audit_diff", insights.audit_diff, False),
    ("audit_diff_paths", insights.audit_diff_paths, False),
    ("sales_forecast", insights.sales_forecast, True),
    ("churn_risk", insights.churn_risk, True),
    ("replenishment", insights.replenishment, True),
    ("sales_anomaly", insights.sales_anomaly, False),
    ("promotion_candidates", insights.promotion_candidates, True),
    ("abc_analysis", insights.abc_analysis, False),
    ("stock_turnover", insights.stock_turnover, True),
    ("action_list", insights.action_list, True),
    ("sales_cube", insights.sales_cube, False),
    ("member_loyalty", insights.member_loyalty, False),
]:
    def _bind(fn=_fn, needs_day=_needs_day):
        def run(t):
            return fn(t, as_of=as_of_date(t)) if needs_day else fn(t)
        return run
    query(_key)(_bind())
